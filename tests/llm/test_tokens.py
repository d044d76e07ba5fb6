import random

from ledgerloom.llm.tokens import WordIds, default_path, pack_ids


def test_remembered_words_give_the_tokenizers_ids():
    words = WordIds(default_path())
    rng = random.Random(4)
    alphabet = "abcXYZéÈßñÜµªº°²½'’.,!?-0129_ \n\t\x1c\x85\xa0ﬁſİ中<|>"
    texts = ["".join(rng.choice(alphabet[: rng.choice((12, 18, 60))]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text in [*texts, "<|endoftext|> a", "the cat's, isn't", "Élève. Straße! ÀÉÎ?"]:
        assert words.text(text) == pack_ids(words.encode(text, add_special_tokens=False).ids), repr(text)


def test_flat_ids_give_the_tokenizers_ids():
    words = WordIds(default_path())
    rng = random.Random(5)
    alphabet = "abcxyzéÈßñÜ!.,-?<|>µªº×÷°²½'’0129_\x85\xa0ﬁſİ中"
    found = ["".join(rng.choice(alphabet[: rng.choice((11, 18, 60))]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    found += ["a", ".", "...", "<|endoftext|>", "isn't", "a" * 60, "é" * 30, "." * 70, "x" * 48 + ".", "É" * 24, "×", "a×b", "ÿ÷"]
    for some in (found, found[:1], [w for w in found if not w.isascii()], ["1", "2"], []):
        ids, sizes = words.flat_ids([w.encode() for w in some])
        assert ids.tolist() == [i for w in some for i in words.encode(w, add_special_tokens=False).ids]
        assert sizes.tolist() == [len(words.encode(w, add_special_tokens=False).ids) for w in some]
