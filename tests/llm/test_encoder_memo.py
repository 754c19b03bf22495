"""The encoder's memo of pre-tokens is bounded; clearing it loses no text that is being read."""

from annspark.llm import bpe
from annspark.llm.queries import tokenizer_path


def test_two_readers_of_one_encoder_outlive_a_cleared_memo(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 20)
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.load_spec(tokenizer_path())), match_added=False)
    roles = ["user", "assistant"] * 60
    texts = [f"w{k}x y{k * 7}z" for k in range(len(roles))]
    pairs = list(zip(encoder.encode_all(roles, chunk=400), encoder.encode_all(texts, chunk=60)))
    assert [(encoder.decode(a), encoder.decode(b)) for a, b in pairs] == list(zip(roles, texts))
