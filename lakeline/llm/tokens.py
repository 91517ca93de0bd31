"""Byte-level BPE ids of whole texts, made a batch at a time.

A text is a chain of units: a run of characters other than white space with the one space before it, or what white
space is left between. The vocabulary's splitting pattern never joins characters of two units, so each distinct unit of
a batch is split and encoded once and its ids are copied to all its places. Texts that hold a special token's string or
white space beyond ASCII are cut by the pattern itself.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from lakeline.llm.common import binary_array, is_space, strings, text_bytes

#: The splitting pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII (Unicode's White_Space property).
WIDE_SPACE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: token bytes by id, merges in rank order, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters, model = byte_letters(), content["model"]
        if model["type"] != "BPE" or content.get("normalizer") or (content.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.pieces: list[bytes] = [b""] * self.size
        for token, i in [*self.ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.pieces[i] = token
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        code = lambda token: self.ids[bytes(letters[c] for c in token)]
        self.merges = np.array([(code(a), code(b), code(a + b)) for a, b in pairs], dtype=np.int64).reshape(-1, 3)
        self.pattern = regex.compile(PATTERN)
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.odd = "|".join([f"[{WIDE_SPACE}]", *(regex.escape(t, special_only=True) for t in self.special)])

    def cut(self, text: str) -> list[str]:
        """The pattern's pieces of a text, special tokens whole."""
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def units(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct units of texts, each occurrence's index among them, and len + 1 offsets of the texts' occurrences."""
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring_regex(texts, self.odd)).as_py():
            cut = [self.cut(t) for t in texts.to_pylist()]
            coded = pa.array([p for c in cut for p in c], pa.string()).dictionary_encode()
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        else:
            data, ends = text_bytes(texts)
            space = is_space(data)
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[ends] = True
            before = np.ones(len(data), dtype=bool)  # the byte before is white space, or the text begins
            before[1:] = space[:-1]
            before |= edge[:-1]
            follows = np.zeros(len(data), dtype=bool)  # a byte that is no white space follows in the text
            follows[:-1] = ~space[1:] & ~edge[1:-1]
            joined = space & follows & (data == 0x20)  # this space belongs to the unit after it
            after = np.zeros(len(data), dtype=bool)
            after[1:] = joined[:-1]
            begins = joined | edge[:-1] | (~space & before & ~after) | (space & (~before | (follows & ~joined)))
            starts = np.flatnonzero(begins)
            coded = binary_array(data, np.append(starts, len(data)), pa.string()).dictionary_encode()
            offsets = np.searchsorted(starts, ends)
        return strings(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False), offsets


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary in the tiktoken library, which encodes a short unit fastest; merges must have the order of their ids."""
    import tiktoken

    v = vocabulary(path)
    if not (np.diff(v.merges[:, 2]) > 0).all():
        raise ValueError(f"{path}: the merges don't follow the ids")
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens={})


def spread(lengths: np.ndarray, flat: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copies each distinct unit's ids (flat, of the given lengths) to all its places; also the texts' offsets in the ids."""
    begins = np.concatenate([[0], np.cumsum(lengths)])
    each = lengths[codes]
    ends = np.concatenate([[0], np.cumsum(each)])
    places = np.arange(ends[-1]) + np.repeat(begins[:-1][codes] - ends[:-1], each)
    return flat[places], ends[offsets]


#: Units whose ids a Python worker remembers; beyond so many it starts anew.
REMEMBERED = 200_000


@functools.lru_cache(maxsize=2)
def remembered(path: str) -> dict[str, bytes]:
    return {}


@functools.lru_cache(maxsize=2)
def opens_with_space(path: str) -> np.ndarray:
    return np.array([p[:1] == b" " for p in vocabulary(path).pieces])


def encode_units(units: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Each unit's number of ids, and all their ids. Units that open with a space are encoded in one call: the pattern parts them there."""
    v, known, encoding = vocabulary(path), remembered(path), encoder(path)
    kind = np.dtype("<u2" if v.size <= 1 << 16 else "<u4")
    new = [u for u in units if u not in known]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = units
    spaced, rest = [], []
    for u in new:
        (spaced if len(u) > 1 and u[0] == " " and not u[1].isspace() else rest).append(u)
    ids = encoding.encode_to_numpy("".join(spaced), disallowed_special=()) if spaced else np.zeros(0, dtype=np.uint32)
    starts = np.flatnonzero(opens_with_space(path)[ids])
    if len(starts) == len(spaced):
        raw, cuts = ids.astype(kind).tobytes(), [*(starts * kind.itemsize).tolist(), len(ids) * kind.itemsize]
        known.update((u, raw[a:b]) for u, a, b in zip(spaced, cuts, cuts[1:]))
    else:
        rest = new
    known.update((u, np.array([v.special[u]] if u in v.special else encoding.encode_ordinary(u), dtype=kind).tobytes()) for u in rest)
    found = [known[u] for u in units]
    return np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // kind.itemsize, np.frombuffer(b"".join(found), dtype=kind)


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other (null: none), and len + 1 offsets into them."""
    units, codes, offsets = vocabulary(path).units(texts)
    return spread(*encode_units(units, path), codes, offsets)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more after each text."""
    more = offsets + np.arange(len(offsets))
    out = np.full(more[-1], end, dtype=ids.dtype)
    plain = np.ones(len(out), dtype=bool)
    plain[more[1:] - 1] = False
    out[plain] = ids
    return out, more
