"""Exact token counts; huge texts by overlapping chunks that resynchronise.

A text longer than a chunk is encoded in overlapping chunks with offsets. Two
neighbouring chunks are spliced at a boundary that both encodings have and that
is proven stable: the end of a token in front of white space. The tokenizers
this module accepts cut there before any merge whatever stands further left or
right, so what follows does not depend on where a chunk began. Where an overlap
holds no such boundary it is widened, in the end to the whole text. Memory
follows the chunk, not the text.

Short texts reuse what is known of their parts. Where the tokenizer's split into
words is one this module can make itself, each distinct word goes through the
library's model once a task; other texts are cut at the proven boundaries and each distinct
piece is encoded by the library once.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable
from types import ModuleType
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_texts

#: Python counts these control characters as white space and the libraries do not.
CONTROL = re.compile("[\x1c-\x1f]")
#: Texts in which Python's letters, digits and white space are those of the libraries: Latin, Greek and Cyrillic letters, ASCII, common punctuation. Superscript digits, fractions and the capital sigma, which lower-cases by context, are left out.
PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u0377\u0384-\u038a\u038e-\u03a1\u03a4-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20ac]*")
PIECE = re.compile(r"\s*\S+|\s+")
MEMO = 400_000


def stable_at_space(spec: dict) -> bool:
    """Whether the tokenizer always cuts where white space follows another character: it splits into words first, by a pattern of which no part holds white space behind another character, and its normalizer acts on single characters and marks."""
    steps = lambda x: x.get("normalizers") or x.get("pretokenizers") or [x] if x else []
    before = {x["type"] for x in steps(spec.get("normalizer"))} <= {"NFC", "NFD", "Replace", "Lowercase"}
    first = (steps(spec.get("pre_tokenizer")) or [{}])[0]
    if first.get("type") == "Split":
        pattern = first.get("pattern", {}).get("Regex", "")
        return before and first.get("behavior") == "Removed" and first.get("invert", False) and "\\s" not in pattern.replace("[^\\s", "")
    return before and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)


def word_pattern(spec: dict) -> re.Pattern | None:
    """The tokenizer's own first split as a pattern of this module's ``re``, equal on PLAIN texts; None if it is another split."""
    first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [spec.get("pre_tokenizer") or {}])[0]
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    if first.get("type") == "Split" and kinds == ["NFC", "Replace", "Lowercase"] and first["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
        return re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    if first.get("type") == "ByteLevel" and not spec.get("normalizer") and first.get("use_regex", True) and not first.get("add_prefix_space", True):
        return re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
    return None


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is printable Latin-1, else one from 256 up in turn."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Words(dict):
    """What is kept of each word, worked out when the word first occurs."""

    def __init__(self, encode: Callable[[str], object]):
        self.encode = encode

    def __missing__(self, word: str) -> object:
        self[word] = made = self.encode(word)
        return made


class Encoder:
    """A tokenizer file with what it has made of words and pieces so far; value() turns ids into what is kept of them."""

    def __init__(self, path: str, value: Callable[[list[int]], object] = len):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.stable, self.memo, self.words, self.value = stable_at_space(spec), {}, Words(self.encode_word), value
        self.model, self.pattern, self.letters = self.tokenizer.model, word_pattern(spec), byte_letters()
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.lower = bool(spec.get("normalizer"))
        first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.split = str.split if first.get("behavior") == "Removed" else PIECE.findall

    def whole(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def pieces(self, text: str) -> list:
        """What value() makes of the parts of the text in turn: words by the model, where the split into words is known to be the library's; else pieces between proven cuts; else the whole."""
        if self.pattern and PLAIN.fullmatch(text) and not any(x in text for x in self.special):
            if len(self.words) > MEMO:
                self.words.clear()
            return list(map(self.words.__getitem__, self.pattern.findall(normalize("NFC", text).lower() if self.lower else text)))
        if not self.stable or CONTROL.search(text):
            return [self.value(self.whole(text).ids)]
        found, memo = self.split(text), self.memo
        if new := set(found).difference(memo):
            if len(memo) > MEMO:
                memo.clear()
                new = set(found)
            self.encode_pieces(list(new))
        return list(map(memo.__getitem__, found))

    def encode_word(self, word: str) -> object:
        shown = word if word.isascii() and word.isalpha() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return self.value([x.id for x in self.model.tokenize(shown)])

    def encode_pieces(self, new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for piece, encoded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo[piece] = self.value(encoded.ids)


def encoder(path: str, value: Callable[[list[int]], object], kind: str) -> Encoder:
    """The encoder of a file, made once in the life of a Python worker; kind names what value() keeps."""
    held = sys.modules.setdefault("_kept_encoders", ModuleType("_kept_encoders")).__dict__
    if (path, kind) not in held:
        held[path, kind] = Encoder(path, value)
    return held[path, kind]


def spliced_count(encoder: Encoder, text: str, chunk: int, overlap: int) -> int:
    """Tokens of the text, from overlapping chunks of chunk + overlap characters."""
    if not encoder.stable or CONTROL.search(text):
        return len(encoder.whole(text).ids)
    ends = lambda a, b: [a + e for _, e in encoder.whole(text[a:b]).offsets]
    total, done, start = 0, 0, 0  # tokens that end at done or before are counted
    here = ends(start, min(len(text), start + chunk + overlap))
    while start + chunk < len(text):
        next_start, width = start + chunk, overlap
        there = ends(next_start, min(len(text), next_start + chunk + width))
        while True:
            stop = min(len(text), next_start + width)
            common = {e for e in here if next_start < e < stop and text[e].isspace()}.intersection(there)
            if common or stop == len(text):
                break
            width *= 2  # no boundary that both have: widen the overlap to the right
            here = ends(start, min(len(text), next_start + width))
            if width >= chunk:
                there = ends(next_start, min(len(text), next_start + chunk + width))
        if not common:
            return total + sum(e > done for e in ends(start, len(text)))
        cut = min(common)
        total += sum(done < e <= cut for e in here)
        start, here, done = next_start, there, cut
    return total + sum(e > done for e in here)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = 1 << 15, overlap: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    tokenizer: path of a .json file of the tokenizers library, readable on every
    executor. Counts are those of encoding the whole text without special tokens
    added; special strings inside a text count as the library's default has it.
    Null text: empty, no tokens. Repeated rows and null ids each return their
    row; other columns are not read; an empty table returns none.
    """

    def row(state: Encoder, text: str) -> tuple[int, int, bool]:
        n = spliced_count(state, text, chunk, overlap) if len(text) > chunk else sum(state.pieces(text))
        return len(text.encode("utf-8", "surrogatepass")), n, n > limit

    return map_texts(id_and_text(docs, id_col, text_col), row, "n_bytes long, n_tokens long, over_limit boolean", [pa.int64(), pa.int64(), pa.bool_()], lambda: encoder(tokenizer, len, "count"))
