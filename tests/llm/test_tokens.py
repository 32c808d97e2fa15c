"""Ids of packed texts against the tokenizer library, where rank file and library differ."""

import unicodedata
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from opsight.llm import packing, tokens

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_ids_of_all_letters_and_special_strings():
    library = Tokenizer.from_file(PATHS[0])
    letters = [c for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (unicodedata.category(c)[0] in "LN" or ord(c) < 0x3000 or ord(c) % 89 == 0)]
    texts = ["".join(f"a{c}1{c}!{c} {c}" for c in letters[i : i + 40]) for i in range(0, len(letters), 40)]
    texts += ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext", "  x  <|endoftext|>  's", "՘ café", "", None]
    expected = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for text, e in zip(texts, expected):
        assert tokens.library_ids(*PATHS, text).tolist() == e.ids


def test_packed_pieces_have_the_library_s_ids(spark):
    text = "one <|endoftext|> two ՘"
    row = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    ids = [*Tokenizer.from_file(PATHS[0]).encode(text, add_special_tokens=False).ids, 2]
    assert row.length == len(ids) and row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
