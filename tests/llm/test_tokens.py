import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.tokens import default_path, load

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=400)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="a'sT \t\n  \x1c　é9\U0001f600<|>endoftx", max_size=60), st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", "'ll", "'S", "\x85"]), max_size=12).map("".join)))
def test_same_ids_and_text_as_the_library(text):
    bpe = load(default_path())
    ids = bpe.encode(text)
    assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert bpe.decode(ids) == TOKENIZER.decode(ids.tolist(), skip_special_tokens=False)
