import random
import re

import numpy as np
import pytest

spans = pytest.importorskip("sparrowdex.llm.sentence_spans")
from sparrowdex.llm.bytewords import word_hashes  # noqa: E402


def word_hash(word):
    data = np.frombuffer(re.sub("[A-Z]", lambda m: m[0].lower(), word).encode(), dtype=np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def sentences(text):
    """(lower-cased words, begin, end with the blanks after it) of each sentence, word by word."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    plain, now = [], []
    for k, (a, b) in enumerate(words):
        now.append((a, b, words[k + 1][0] if k + 1 < len(words) else len(text)))
        if text[b - 1] in ".!?" or "\n" in text[b : now[-1][2]] or k + 1 == len(words):
            plain.append(now)
            now = []
    cut = []
    for s in plain:
        now = []
        for w in s:
            now.append(w)
            if len(s) > spans.LONGEST and (word_hash(text[w[0] : w[1]]) % spans.CUT == 0 or len(now) == 4 * spans.LONGEST):
                cut.append(now)
                now = []
        cut += [now] if now else []
    low = lambda s: [re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]) for a, b, _ in s]
    return [(low(s), s[0][0], s[-1][2]) for s in cut]


def brute(rows):
    docs = sorted(((i is None, i or 0, t) for i, t in set(rows) if t is not None), key=lambda r: r[:2])
    seen, out = {}, {}
    for _, i, t in docs:
        s = sentences(t)
        covered = set()
        for k in range(len(s)):
            j, n = k, 0
            while j < len(s) and (j - k < spans.RUN or n < spans.MIN_WORDS):
                n += len(s[j][0])
                j += 1
            if j - k >= spans.RUN and n >= spans.MIN_WORDS:
                run = tuple(w for x in s[k:j] for w in x[0])
                if run in seen:
                    covered |= set(range(k, j))
                seen.setdefault(run, (i, k))
        kept = t[: s[0][1]] if s else t
        out[i, t] = (kept + "".join(t[a:b] for k, (_, a, b) in enumerate(s) if k not in covered), len(s), len(covered))
    return sorted(((i, *out.get((i or 0, t), (None, 0, 0))) for i, t in rows), key=str)


def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(500)] + ["é", "Ünd", "X"]
    prose = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", ".", "!", ".\n", "?\t"]) for _ in range(n))
    passage, rows = prose(60), []
    for k in range(60):
        text = prose(r.randint(0, 200))
        if r.random() < 0.4:
            text += ".\n" + passage.upper() if r.random() < 0.3 else " x.\n" + passage + " " + prose(20)
        rows.append((k, text))
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, passage + "\n" + passage), (102, None), (103, ""), (104, " \n"), (105, "a. b. c. " * 30)]
    return rows + [(None, passage), (106, " ".join(["word"] * 300)), (107, "z" * 5000 + ". " + passage), (108, "one. two. three.")]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, marks int").repartition(3)
    got = sorted((tuple(r) for r in spans.drop_repeated_spans(df).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[3] for r in got) > 100


def test_empty(spark):
    assert spans.drop_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_passages_are_covered(spark):
    word = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    two = f"{word('a', 24)}. {word('b', 24)}."  # two sentences, 48 words
    tail = f"{word('c', 10)}. {word('d', 10)}. {word('e', 10)}. {word('f', 3)}. {word('g', 3)}."
    rows = [
        (1, f"{two} {word('h', 7)}. {tail}"),
        (2, f"{word('i', 9)}. {two} {word('j', 9)}."),
        (3, f"{word('k', 9)}. {tail} {word('l', 30)}."),  # the tail's last runs begin in the passage and end in the text's own words
        (4, f"{word('m', 9)} {two} {word('n', 9)}."),  # the first sentence is glued to other words: its second is too short to stand alone
        (5, f"{word('o', 5)}. " * 40),  # each sentence but the first continues a repeat
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text.strip(), r.n_removed) for r in spans.drop_repeated_spans(df, whole=True).collect()}
    assert got[1] == (rows[0][1], 0)
    assert got[2] == (f"{word('i', 9)}. {word('j', 9)}.", 2)
    assert got[3] == (f"{word('k', 9)}. {word('l', 30)}.", 5)
    assert got[4][1] == 0
    assert got[5] == (f"{word('o', 5)}.", 39)


def whole_brute(rows):
    """Sentences covered if every run of whole sentences that reaches MIN_WORDS words is looked up, whatever its length."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        s, covered = sentences(t), set()
        for k in range(len(s)):
            for j in range(k, len(s)):
                run = tuple(w for x in s[k : j + 1] for w in x[0])
                if len(run) >= spans.MIN_WORDS:
                    if seen.setdefault(run, (i, k)) != (i, k):
                        covered |= set(range(k, j + 1))
        out[i] = (len(s), len(covered))
    return out


def test_whole_equals_all_runs(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", ".", "!"]) for _ in range(n)) + "."
    passages = [prose(r.randint(25, 70)) for _ in range(4)]
    rows = [(k, " ".join([prose(r.randint(1, 40)), r.choice(passages), prose(r.randint(1, 40))])) for k in range(24)]
    got = spans.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), whole=True).collect()
    assert {x.doc_id: (x.n_sentences, x.n_removed) for x in got} == whole_brute(rows)
