"""Words' ids over several calls against the library, with words that are numbered as parts of others."""

import public_tokenizers
from tokenizers import Tokenizer

from tandem.llm.chunkstore import WordIds


def test_words_over_calls():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), WordIds(path)
    for texts in (["end. end stop, stop,", "... ,"], ["stop end.", "new, new. new", ""], ["one; end... two", "two one ;"], ["new one"]):
        for t, ids in zip(texts, words.encode([t.encode() for t in texts])):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert list(words.known.values()) == list(range(len(words.lengths)))
        assert words.starts.tolist() == (words.lengths.cumsum() - words.lengths).tolist()
    known = len(words.lengths)
    words.encode([b"new one", b"stop,"])
    assert len(words.lengths) == known
