"""The encoder's ids against the library's own, on texts of awkward pieces."""

import random

import numpy as np
import public_tokenizers
import pytest

from tessera.llm.tokens import Encoder

PIECES = [*"aZéßÈñøÿ×÷ªµİΣς漢😀", "é", *" .,;'!<|>09#-_`~{}[]\\/\"", "\n", "\t", "\r", "\x1c", "\x85", " ", " ",
          "it's", " I'LL", "<|endoftext|>", "word", " Straße", ".\nNext", "\n\n"]


@pytest.mark.parametrize("name,cut", [("byte_bpe_50k.json", "spaces"), ("word_bpe_49k.json", "words")])
def test_ids_are_the_librarys(name, cut):
    rnd = random.Random(8)
    texts = ["", None] + ["".join(rnd.choices(PIECES, k=rnd.randint(0, 40))) for _ in range(5000)]
    encode = Encoder(public_tokenizers.path(name), cut, cache_bytes=1 << 18)  # small, so that parts go and come back
    plain = encode.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = [ids for lo in range(0, len(texts), 100) for ids in encode(texts[lo:lo + 100])]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [p.ids for p in plain]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_borders_of_texts_in_a_batch(name):
    ends = ["", " ", "  ", "\n", " \n", "a", "a ", "a  ", " a", "  a", ".", "'s", "\u00a0", "é"]
    texts = [a + b for a in ends for b in ends]
    encode = Encoder(public_tokenizers.path(name))
    plain = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
    for some in (texts, texts[::-1], ["", ""], []):
        want = [p.ids for p in (plain if some is texts else plain[::-1] if some == texts[::-1] else [plain[0]] * len(some))]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encode(some)] == want
    long = "x" * 70_000 + " y " + "z" * 600
    assert np.frombuffer(encode([long])[0], "<u4").tolist() == encode.tokenizer.encode(long, add_special_tokens=False).ids


def test_other_tokenizers_are_exact(tmp_path):
    """A cased file that is not byte-level: whole texts go to the library; a wrong cut is refused."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(["A", "a", "b", "ab", " "])}, merges=[("a", "b")]))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "other.json"))
    texts = ["Aab b", "", None, "ba AB a"]
    got = Encoder(str(tmp_path / "other.json"))(texts)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [other.encode(t or "", add_special_tokens=False).ids for t in texts]
    with pytest.raises(ValueError):
        Encoder(str(tmp_path / "other.json"), "words")


def test_names_shared_by_two_pieces():
    """Pieces of one name and different checks keep ids of their own, in one batch and in later ones."""
    from tessera.llm.piece_cache import PieceCache

    cache, asked = PieceCache(1 << 10, 1 << 12), []
    names, checks = np.array([5, 5, 9, 5], np.uint64), np.array([1, 2, 3, 1], np.uint64)

    def learn(at):
        asked.extend(checks[at].tolist())
        return [[int(checks[i])] * 2 for i in at]

    for _ in range(3):
        flat, n = cache(names, checks, learn)
        assert flat.tolist() == [1, 1, 2, 2, 3, 3, 1, 1] and n.tolist() == [2] * 4
    assert asked == [1, 2, 3] or sorted(asked) == [1, 2, 3]
    flat, _ = cache(names[:1], checks[1:2], lambda at: [[7]])
    assert flat.tolist() == [7]
