import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

pii = pytest.importorskip("sparrowdex.llm.pii_crf")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and max(map(int, m[0].split("."))) > 255:
                continue
            if k == 2 and not (14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "@", "x-1", ".", "1", "25", "4111 1111-1111 1111", "+1", " ", "(", "é", "256", "0", "-", "4" * 9, "%", "\n"]), max_size=30))
def test_base_spans_follow_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "1." * 200_000, "a" * 300_000 + "@", "+1" + "(" * 300_000, "a@" * 100_000):
        pii.base_spans(text)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    move = np.maximum(rng.normal(size=(pii._K + 1, pii._K)) + pii._grammar(), pii._FORBIDDEN)
    model = pii.Crf(np.zeros((1, pii._K)), move)
    size = [3, 1, 4, 2]
    scores = rng.normal(size=(sum(size), pii._K)).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(size)])
    got = model.viterbi(scores, first)
    for a, b in itertools.pairwise(first):
        total = {p: move[-1, p[0]] + sum(scores[a + i, x] for i, x in enumerate(p)) + sum(move[x, y] for x, y in itertools.pairwise(p)) for p in itertools.product(range(pii._K), repeat=b - a)}
        assert tuple(got[a:b]) == max(total, key=total.get)


@pytest.mark.parametrize("n", [2 * pii.BLOCK + 1, 3 * pii.BLOCK, 3 * pii.BLOCK + 1, 1000])
def test_blocks_give_the_path_of_one_long_pass(n, monkeypatch):
    rng = np.random.default_rng(n)
    model = pii.Crf(np.zeros((1, pii._K)), np.maximum(rng.normal(size=(pii._K + 1, pii._K)) + pii._grammar(), pii._FORBIDDEN))
    scores = rng.normal(size=(n + 5, pii._K)).astype(np.float32)
    first = np.array([0, 5, n + 5])
    together = model.viterbi(scores, first)
    monkeypatch.setattr(pii, "LONG", 100)
    assert (model.viterbi(scores, first) == together).all()


def test_slopes_are_those_of_finite_differences():
    rows = [("Call 555-123-4567, says Ann Lee.", [(5, 17, "local_phone"), (24, 31, "person")]), ("No one.", []), ('key = "ab12cd34ef56ab12"', [(7, 23, "secret")])]
    examples = pii.Examples(rows)
    rng = np.random.default_rng(4)
    at = [rng.normal(size=(pii._FEATURES, pii._K)), rng.normal(size=(pii._K + 1, pii._K))]
    _, *slopes = examples.loss_and_slopes(*at, 0.3)
    for which, slope in enumerate(slopes):
        moved = 0
        for spot in map(tuple, rng.integers(0, slope.shape, (60, 2))):
            if which == 1 and pii._grammar()[spot] < 0:
                continue
            ends = []
            for step in (1e-5, -1e-5):
                at[which][spot] += step
                ends.append(examples.loss_and_slopes(*at, 0.3)[0])
                at[which][spot] -= step
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(slope[spot], abs=1e-4)
            moved += 1
        assert moved > 10


# names, frames and two languages that the training table does not have
GIVEN = "Björn Yuki Svetlana Omar Ingrid Matteo Zofia Ravi Amara Lieselotte".split()
FAMILY = "Aalto Okafor Petrov Haddad Bianchi Wójcik Iyer Vance Thornton Ueda".split()
FRAMES = (
    "Thanks to {person} for the idea.", "Sincerely, {person}", "My friend {person} paints.", "We spoke with {person} at length.", "Meet Dr. {family} at the door.", "Frau {family} ist krank.",
    "Mi chiamo {person} e vivo qui.", "O meu nome é {person}.", "Reach the office on {local} before noon.", "fax {local}", "ligue para {local} agora", "Il mio telefono: {local}",
    "please email {spoken} about it", "write {spoken}", 'the client token = "{secret}" was lost', "PASSWORD: {secret}",
)
CLEAN = (
    "The river was high and the bridge closed.", "Il treno parte alle 10:30 da Roma.", "O livro custa 45 euros.", "Only 3 of 250 ships came back in 1807.", "Wir gehen am Abend in den Wald.",
    "On Tuesday the council met again.", "Section 4.2 was changed on 2021-03-04.", "The dot is at the end.", "She keeps a key for the door.", "Elle va au marché avec des amis.", "No name was given.", "READ THIS NOTICE FIRST!!",
)


def test_held_out_names_frames_and_languages():
    rows = pii.labelled_table(seed=5, templates=FRAMES, given=GIVEN, family=FAMILY, copies=6)
    rows = [(text, spans) for text, spans in rows if spans] + [(text, []) for text in CLEAN]
    hit = miss = wrong = 0
    for (_, _, spans), (_, want) in zip(pii.find_spans(pii.trained(), pa.array([t for t, _ in rows])), rows, strict=True):
        got, want = {(a, b) for a, k, b in spans if k >= len(pii.BASE_KINDS)}, {(a, b) for a, b, _ in want}
        hit, miss, wrong = hit + len(got & want), miss + len(want - got), wrong + len(got - want)
    assert hit / (hit + miss) > 0.85 and wrong < 0.1 * hit


def spans_of(text, model=None):
    ((_, _, spans),) = pii.find_spans(model or pii.trained(), pa.array([text]))
    return [(pii.KINDS[k], text[a:b]) for a, k, b in spans]


def test_a_number_is_found_after_any_number_of_words():
    texts = ["word " * n + "call 555-123-4567 today" for n in [*range(301), 5_000]]
    for text, _, spans in pii.find_spans(pii.trained(), pa.array(texts)):
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [("local_phone", "555-123-4567")]


def test_plain_sentences():
    assert spans_of("Please contact Wei Zhang tomorrow.") == [("person", "Wei Zhang")]
    assert spans_of("John Smith lives in Paris.") == [("person", "John Smith")]
    assert spans_of("Regards, Olivia Thompson") == [("person", "Olivia Thompson")]
    assert spans_of('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"') == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert spans_of("commit 04dbebab91ab85687d33eeaaf9ac699e1188f962") == spans_of("THE NAME!! OF!! THE!! ROSE!!") == spans_of("de de de de de de") == []


def test_cue_words_are_whole_words():
    tok = pii.tokenize(np.frombuffer(b"telephone telephony Telephone phone", dtype=np.uint8), np.array([0, 35]))
    assert tok.cue[0] == tok.cue[2] == tok.cue[3] != 0 == tok.cue[1]


def test_a_table_of_ones_own(spark):
    schema = "text string, spans array<struct<start: int, end: int, kind: string>>"
    rows = [(f"<< Zed {n} >>", [(3, 6, "person")]) for n in ("a", "bb", "ccc")] * 20 + [("Zed alone", []), ("no", None), (None, None)] * 10
    model = pii.fit(pii.labelled_rows(spark.createDataFrame(rows, schema)))
    assert spans_of("well << Zed dd >> done", model) == [("person", "Zed")] and spans_of("Zed alone", model) == []
    assert spans_of("Mr. Brown", pii.fit([])) == []
    with pytest.raises(ValueError):
        pii.fit([("x", [(0, 1, "shoe")])])


def test_rows(spark):
    rows = [(1, "é Mr. Brown, a.b@c.de and 8.8.8.8", "x"), (2, None, "x"), (3, "", "x"), (None, "+1 (017) 555-7713", "x"), (1, "é Mr. Brown, a.b@c.de and 8.8.8.8", "x")]
    rows += [(9, "word " * 50_000 + "call 555-123-4567", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = pii.pii_spans(df).collect()
    assert all(r.n_spans == len(r.spans.split(",")) if r.spans else r.n_spans == 0 for r in found)
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_phone, r.spans) for r in found}
    assert got == {
        (1, 1, 1, 0, "person:6:11,email:13:21,ip:26:33"),
        (2, 0, 0, 0, ""),
        (3, 0, 0, 0, ""),
        (None, 0, 0, 1, "phone:0:17"),
        (9, 0, 0, 0, "local_phone:250005:250017"),
    }
    masked = [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()]
    assert (2, None, "x") in masked and (3, "", "x") in masked
    assert (1, "é Mr. [PERSON], [EMAIL] and [IP]", "x") in masked
    assert pii.pii_spans(df.limit(0)).collect() == []
