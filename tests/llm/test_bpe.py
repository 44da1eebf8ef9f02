import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import bpe
from graphloom.llm.queries import op1_bpe
from graphloom.llm.tokens import default_path, load
from tests.llm.helpers import SF, empty_docs, odd_docs, sha, texts

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def want(docs):
    out = []
    for i, text in docs:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
        out.append((-1 if i is None else i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(TOKENIZER.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def got(df):
    return sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in df.collect())


def test_whole_table(spark):
    assert got(op1_bpe(spark, SF)) == want(texts(spark))


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_odd_rows(spark, bits):
    docs = odd_docs(spark)
    shared = "a<|endoftext|>b  c\n\n " * 200 + "漢字仮名" * 2000 + " 's" * 300
    more = spark.createDataFrame([(20 + i, f"{i}" + shared) for i in range(4)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    assert got(bpe.encode_documents(both, bits=bits)) == want([tuple(r) for r in both.collect()])
    assert bpe.encode_documents(docs).count() == docs.count()
    assert bpe.encode_documents(empty_docs(spark)).count() == 0


CODEC = load(default_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", " b", "\n", "'ll", "é", "漢", "<|endoftext|>", " \U0001f600", "12", "!!", "\x85", " ."]), max_size=60).map("".join), st.lists(st.integers(1, 200), max_size=8))
def test_stitched_chunks_agree_with_the_whole(text, at):
    codec, data = CODEC, text.encode()
    cuts = sorted({0, *(c for c in at if c < len(data) and data[c] & 0xC0 != 0x80)}) if data else [0]
    encode = lambda part: codec.encode(part.decode())
    ends = [*cuts[1:], len(data)]
    ids = bpe.stitch(data, cuts, lambda i: encode(data[cuts[i] : ends[i]]), encode)
    assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_cuts_follow_the_content():
    body = " ".join(f"word{i * i}" for i in range(5000)).encode()
    a, b = (set(bpe.chunks_of(head + body)[1]) for head in (b"", b"another beginning, " * 20))
    assert len(a & b) >= len(a) - 3
    cuts = bpe.cuts_of("漢字".encode() * 20_000)
    assert all(bpe.LEAST <= y - x <= bpe.MOST + bpe.SNAP + 4 for x, y in zip(cuts, cuts[1:], strict=False))
