import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from stocklens.llm import byte_bpe

SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def reference():
    with open(P.path(byte_bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    kinds = ["ab", "  \n\t", " a", "é ö", "0123 .", "I'll we'd 'S ", " 　x\x85 ", "日本語 テキスト", "🙂👍🏽 a", "\x1c\x1d ​", "\x00\x01 "]
    made = ["", " ", "a   b", "a\n  b", " \n ", "tail   ", "<|endoftext|>", "word " * 30_000]
    made += ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return made + ["".join(rng.choice("ab \n\t é1.") for _ in range(rng.randint(0, 30))) for _ in range(1500)]


def test_same_ids_as_reference(reference):
    made = texts()
    got = list(byte_bpe.codec().encode(made))
    assert got == [",".join(map(str, reference.encode_ordinary(t))) for t in made]


def test_digests_nulls_and_extra_columns(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(texts()[:300])] + [(None, None, None), (5, None, "x"), (5, None, "x")]
    got = byte_bpe.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_round_trip_and_offsets(spark):
    rows = [(1, "naïve 🙂 日本", ""), (2, None, ""), (3, "plain text", "")]
    encoded = byte_bpe.encode(spark.createDataFrame(rows, SCHEMA))
    back = {r.doc_id: bytes(r.bytes).decode() for r in byte_bpe.decode(encoded).collect()}
    assert back == {1: rows[0][1], 2: "", 3: "plain text"}
    first = encoded.where("doc_id = 1").first()
    assert first.starts[0] == 0 and first.ends[-1] == len(rows[0][1])
    assert all(a < b for a, b in zip(first.starts, first.ends))


def test_empty_table(spark):
    assert byte_bpe.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_split_characters_and_another_pattern(spark, reference):
    """Offsets against brute force over the bytes of the tokens; a pattern that joins words cuts as tiktoken does."""
    made = texts()[:400]
    got = {r.doc_id: r.n_split for r in byte_bpe.digests(spark.createDataFrame([(i, t, "") for i, t in enumerate(made)], SCHEMA), offsets=True).collect()}
    for i, t in enumerate(made):
        at, inside = 0, 0
        for token in reference.decode_tokens_bytes(reference.encode_ordinary(t)):
            inside += t.encode()[at] & 0xC0 == 0x80
            at += len(token)
        assert got[i] == inside
    pattern = r"[a-z ]+|[^a-z ]"
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=reference._mergeable_ranks, special_tokens={})
    assert list(byte_bpe.codec(None, pattern).encode(made)) == [",".join(map(str, other.encode_ordinary(t))) for t in made]
