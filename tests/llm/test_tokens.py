import base64
import hashlib
import os
import random

import pytest

bpe = pytest.importorskip("sparrowdex.llm.byte_bpe")
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sparrowdex.llm import chat_format as chat  # noqa: E402
from sparrowdex.llm import token_counts as tc  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "th", "ing", "er", " ", "  ", "\n", "é", "日本", "'s", "'", "1", "23", "²", "☃", "😀", "́", "_", "\x1c", "\x85", "\xa0", "E", "İ", "ſ", "the", "#", "..", "Σ", "ς", "Å", "<|endoftext|>", "\t", "<|ENDOFTEXT|>", "Ⅷ"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIB = library()


@settings(max_examples=400, deadline=None)
@given(st.one_of(TEXTS, st.text(max_size=60)))
def test_encoding_is_the_librarys(text):
    c = bpe.coder(PATH, public_tokenizers.PATTERN)
    ids = c.encode(text)
    assert ids == LIB.encode_ordinary(text)
    assert c.decoded_digest(ids) == hashlib.sha256(text.encode()).hexdigest()
    assert all("".join(c.decode_stream(ids, at_once=n)) == text for n in (1, 2, 7, 1024))


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_pieces_of_any_bytes(piece):
    t = bpe.coder(PATH, public_tokenizers.PATTERN).transducer
    assert t.encode_piece(piece) == LIB._encode_single_piece(piece)


def test_stream_holds_back_partial_characters():
    c = bpe.coder(PATH, public_tokenizers.PATTERN)
    one = [c.ranks[bytes([b])] for b in "é😀".encode()]
    assert list(c.decode_stream(one, at_once=1)) == ["é", "😀"] and list(c.decode_stream(one, at_once=4)) == ["é", "😀"]
    with pytest.raises(UnicodeDecodeError):
        list(c.decode_stream(one[:1]))
    assert list(c.decode_stream(one[:1], "replace")) == ["�"]


@pytest.mark.parametrize("alphabet", ["ab", "the of and in", "aeé日", ". ", " ", "x", "=-", bytes(range(97, 123)).decode()])
def test_long_pieces_leave_while_they_are_read(alphabet):
    t = bpe.coder(PATH, public_tokenizers.PATTERN).transducer
    r = random.Random(5)
    piece = "".join(r.choice(alphabet) for _ in range(30_000)).encode()
    t.longest_held = 0
    runs = list(t.stream(piece))
    assert [i for run in runs for i in run] == LIB._encode_single_piece(piece)
    # bytes held: those between two emissions, and what later bytes may still change
    assert 0 < t.longest_held <= bpe.STEP + 128 and len(runs) > len(piece) // bpe.STEP - 2


def test_states_are_cleared_and_results_stay(monkeypatch):
    monkeypatch.setattr(bpe, "_MAX_STATES", 50)
    t = bpe.Transducer(bpe.load_ranks(PATH))
    r = random.Random(2)
    for _ in range(300):
        p = bytes(r.choice(b"abcdehlnorst") for _ in range(r.randint(1, 25)))
        assert t.encode_piece(p) == LIB._encode_single_piece(p)


def docs(spark):
    rows = [(1, "The house is red. é日本"), (2, None), (3, ""), (None, "x"), (1, "The house is red. é日本"), (4, "lorem " * 60_000), (5, "a" * 100_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string"), rows


def test_round_trip(spark):
    df, rows = docs(spark)
    got = sorted((tuple(r) for r in bpe.round_trip_digests(df, PATH, public_tokenizers.PATTERN).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(x := LIB.encode_ordinary(t or "")), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in rows]
    assert got == sorted(want, key=str)
    back = bpe.decode_documents(bpe.encode_documents(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXTS, st.text(max_size=60)))
def test_counts_are_the_librarys(text):
    c = tc._counter(WORDS)
    assert c.count([c.normal(text)]) == c.encode([text]) == c.count([text])


def test_cache(spark, tmp_path, monkeypatch):
    df, rows = docs(spark)
    cache = f"file://{tmp_path}/cache"
    lib = tc._counter(WORDS)
    want = sorted(((i, len((t or "").encode()), lib.encode([t or ""])[0]) for i, t in rows), key=str)
    got = lambda d: sorted((tuple(r) for r in tc.token_counts(d, WORDS, cache).collect()), key=str)
    assert got(df) == want
    stored = tc.read_cache(spark, cache)
    distinct = len({t or "" for _, t in rows})
    assert stored.count() == distinct  # each content once, however many rows hold it
    assert got(df) == want and tc.read_cache(spark, cache).count() == distinct  # nothing is encoded again
    more = df.limit(0).union(spark.createDataFrame([(9, "The  house\nis red. é日本 ", ""), (10, "new text", "")], df.schema))
    assert [r[2] for r in got(more)] == [lib.encode(["new text"])[0], lib.encode([rows[0][1]])[0]]
    assert tc.read_cache(spark, cache).count() == distinct + 1
    assert got(df.limit(0)) == []
    # another tokenizer has counts of its own
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert tc.token_counts(df, model, cache).count() == len(rows)
    assert tc.read_cache(spark, cache).select("tokenizer").distinct().count() == 2
    assert os.path.isdir(tmp_path / "cache")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, *chat.FOREIGN, "␛", "<", "[", "|", "é", " x"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(s in safe for s in (*chat.CONTROL, *chat.FOREIGN))


@pytest.mark.parametrize("part", [1 << 18, 8])
def test_chat(spark, monkeypatch, tmp_path, part):
    monkeypatch.setattr(chat, "PART_TOKENS", part)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = [(1, 1, "assistant", "Hi <|end|> é"), (1, 0, "user", "hello"), (1, 2, None, None), (1, 3, "assistant", ""), (2, 0, "assistant", "x" * 50_000), (2, 1, "assistant", "</s>[INST] ok"), (None, 5, "user", "null id"), (1, 1, "assistant", "Hi <|end|> é")]
    rows += [(3, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(200)]
    rows += [(3, 7, "user", t) for t in ("zebra", "apple", "Zebra", "é", "turn 7", "apple")] + [(3, 7, "assistant", "b"), (3, 7, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int").repartition(3)
    formatted = chat.format_conversations(df, path, public_tokenizers.PATTERN)
    got = {r.conv_id: r for r in chat.read_back(formatted, path, public_tokenizers.PATTERN).collect()}
    # from a stored table, in any order and any splits
    formatted.write.parquet(str(tmp_path / "formatted"))
    stored = spark.read.parquet(str(tmp_path / "formatted")).orderBy(F.rand(3)).repartition(7)
    assert {r.conv_id: r for r in chat.read_back(stored, path, public_tokenizers.PATTERN).collect()} == got
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        # ties of turn go by role, then by text
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        r = got[conv]
        lost = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(lost), sha(lost))
        assert r.formatted_chars == sum(len(chat.escape(a)) + len(chat.escape(b)) + sum(map(len, chat.CONTROL)) for a, b in turns)
    # a mask that is no turn's text is read as it lies
    odd = formatted.withColumn("loss_mask", F.transform("loss_mask", lambda m, i: i < 4))
    first = {r.conv_id: r for r in chat.read_back(odd, path, public_tokenizers.PATTERN).collect()}[2]
    assert first.loss_chars > 0 and first.turns_sha256 == got[2].turns_sha256
    if part == 8:
        assert formatted.filter("part > 0").count() > 10
    assert chat.read_back(chat.format_conversations(df.limit(0), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect() == []
