import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeworks.llm.encode import TOKENIZER, Encoder, count_tokens, encode

tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
tok.encode_special_tokens = True
enc = Encoder(open(TOKENIZER, "rb").read())


def want(text):
    return tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text(text):
    assert enc.encode(text.encode()) == want(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["'", "s", "'ll", " ", "  ", "\n", "\t", "q", "Z", "é", "中", "١", "9", "½", "🙂", "\u00a0", "\u200b", "_", "-", "the", "İ"]), max_size=40))
def test_awkward_neighbours(parts):
    text = "".join(parts)
    assert enc.encode(text.encode()) == want(text)


@pytest.mark.parametrize("text", ["", " ", "\n\n", "<|endoftext|>", "a" * 50_000, "word " * 40_000, "ﬁrst ofﬁce İstanbul عقد 合同编号 未定"])
def test_chosen_texts(text):
    assert enc.encode(text.encode()) == want(text)


def test_frame(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "Hello world"), (4, "Hello world"), (None, "x")]
    df = spark.createDataFrame(rows, "ids bigint, text string")
    got = sorted((r.ids is None, r.ids or 0, list(r["n"])) for r in encode(df.withColumnRenamed("ids", "doc"), "doc", "text").toDF("ids", "n").collect())
    assert got == sorted((i is None, i or 0, want(t or "")) for i, t in rows)
    assert sorted(r.n_tokens for r in count_tokens(df, "ids", "text").collect()) == sorted(len(want(t or "")) for _, t in rows)
    assert encode(df.limit(0), "ids", "text").count() == 0
