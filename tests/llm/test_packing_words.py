"""New words are encoded once for the texts that bring them, whatever the text they stand in."""

import public_tokenizers

from veridrift.llm import packing


def test_new_words_of_texts_together():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, asked = packing.WordEncoder(path), []
    one = coder.word
    coder.word = lambda w: asked.append(w) or one(w)
    texts = ["It's o'clock, they'll''s DON'T'VE '' ''t 'tis", "straße_x2²³ café's ½ don't", "", "it's __ o'clock ¿qué? «x»'d"]
    want = [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(texts)] == want and [x.tolist() for x in coder.encode(texts)] == want
    assert len(asked) == len(set(asked)) == len(coder.known) and coder.words("tab\x01") is None
    assert coder.words("Don't x2_²") == ["don", "'t", "x", "2", "_", "²"]
