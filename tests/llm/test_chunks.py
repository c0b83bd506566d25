"""What the encoder of op3_token_files remembers."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from trelliq.llm.token_files import ChunkEncoder


def test_words_with_signs_take_no_room():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    text = 'Words, words; (words) "Words" words... don\'t WORDS!? Bücher, x2, --'
    mine, lib = ChunkEncoder(source), Tokenizer.from_str(source)
    for _ in range(2):
        ids = [int.from_bytes(raw, "little") for raw in (mine.encode(text)[i : i + 4] for i in range(0, len(mine.encode(text)), 4))]
        assert ids == lib.encode(text, add_special_tokens=False).ids
    assert "words" in mine.memory and "," in mine.memory and "words;" not in mine.memory and "Words," not in mine.memory


def test_a_word_is_encoded_once_whatever_its_case_and_signs():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    mine, lib = ChunkEncoder(source), Tokenizer.from_str(source)
    same = lambda text: np.frombuffer(mine.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert same("Bücher, bücher; BÜCHER bücher.")
    assert set(mine.memory) - {""} == {"bücher", ",", ";", "."}
    # Letters, numerals and signs on both sides of what counts as a word.
    for c in map(chr, [*range(0x20, 0x280), 0x301, 0x3B1, 0x416, 0x1E9E, 0x2C65, 0x2160, 0xFF21]):
        assert same(f"{c} a{c} {c}a a{c}b. A{c}, {c}; {c}{c}!? x{c}'s <{c}> a.{c}"), hex(ord(c))
