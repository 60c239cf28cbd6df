"""The fast form of the public vocabulary gives the ids of its JSON form, for every code point and for long runs."""

from tokenizers import Tokenizer

from kairoframe.llm.packing import Vocabulary


def test_every_code_point_beside_letters_digits_spaces_and_itself():
    vocabulary = Vocabulary.public()
    named = Tokenizer.from_file(vocabulary.json_path)
    for start in range(0, 0x110000, 64):
        if 0xD800 <= start < 0xE000:  # halves of pairs are not text
            continue
        text = "|".join(f"a{c}1 {c}{c}b \n{c}  {c}'{c}" for c in map(chr, range(start, start + 64)))
        assert vocabulary.encode(text).tolist() == named.encode(text, add_special_tokens=False).ids, hex(start)


def test_long_runs():
    vocabulary = Vocabulary.public()
    named = Tokenizer.from_file(vocabulary.json_path)
    for text in ("a" * 3000, " " * 3000 + "x", "\n" * 3000, "é" * 2000, "12" * 1500, "'s" * 1500, "?!" * 1500, "日本" * 1000, " a\n" * 2000):
        assert vocabulary.encode(text).tolist() == named.encode(text, add_special_tokens=False).ids
