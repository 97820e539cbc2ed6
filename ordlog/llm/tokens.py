"""Token ids of whole texts.

For a tokenizer of word pieces that drops white space (normal form C, lower case, words that end in a marked symbol), a text is split at ASCII
white space, and each distinct chunk of a batch is encoded once; a bounded cache keeps them for later batches. Pieces are merged by a byte-pair encoder that takes the
end mark as a byte that no word has. Any other tokenizer file is used as it is. Both give what tokenizers' own encode gives.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept in a worker's cache, which is emptied when full, and the longest that are kept: together they bound its memory.
CACHE, LONGEST = 600_000, 64
#: From this character on, tables of letters differ between libraries and versions; chunks with them go to the tokenizer itself.
PLAIN = "\u0500"

# Fixed values of the tokenizer format: what the fast way requires of a file.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_END = "</w>"


def _printable_bytes() -> dict[str, int]:
    """The format's text form of each byte: itself if it prints in Latin-1, else the next free character from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = spec["model"].get("end_of_word_suffix") == _END and (spec.get("normalizer") or {}).get("normalizers") == _NORMAL and _SPLIT in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\")
        if self.fast:
            import regex
            import tiktoken

            self.words = regex.compile(_SPLIT).findall
            code = _printable_bytes()
            ranks = {}
            for token, i in spec["model"]["vocab"].items():
                body, end = (token[: -len(_END)], b"\n") if token.endswith(_END) else (token, b"")
                ranks[bytes(code[c] for c in body) + end] = i
            lone = ranks.keys() & {b"\n"}
            core = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={}) if lone else None
            self.fast = core is not None
            self.piece = core and core._core_bpe.encode_single_piece
            self.cache: dict[str, bytes] = {}

    def _miss(self, chunk: str) -> bytes:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # the format lowers each character by itself
        if not text.isascii() and max(chunk) >= PLAIN:
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        elif text.isalpha():
            ids = self.piece(text.encode() + b"\n")
        elif text[:-1].isalpha() and not text[-1].isspace() and not text[-1].isalnum():  # a word and one mark
            ids = self.piece(text[:-1].encode() + b"\n") + self.piece(text[-1].encode() + b"\n")
        else:
            ids = [i for w in self.words(text) for i in self.piece(w.encode() + b"\n")]
        out = array("I", ids).tobytes()
        if len(chunk) <= LONGEST:
            self.cache[chunk] = out
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, where each text begins and the last ends). A null text has none."""
        if not self.fast:
            each = [self.whole.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.array([i for ids in each for i in ids], np.uint32), np.cumsum([0, *map(len, each)])
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        get, miss = self.cache.get, self._miss
        found = [get(c) or (miss(c) if c else b"") for c in coded.dictionary.to_numpy(zero_copy_only=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, first = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        flat = ids[np.repeat(first[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = lists.offsets.to_numpy()
        return flat, np.append(0, ends)[bounds - bounds[0]]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
