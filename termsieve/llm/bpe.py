"""Byte-pair encoding of whole texts by backtracking over longest token matches.

A word's encoding is found left to right: at each position the longest vocabulary entry is tried,
then shorter prefixes of it; an entry stands only if it is compatible with the entry before it,
that is, if merging the two entries' text by rank order would give exactly these two. Ends known to
lead nowhere are remembered, so each position is tried once for each prefix and the time is linear
in the word. Longest matches come from an Aho-Corasick automaton over the vocabulary. Decoding
copies byte ranges of one blob through an offset table.

White space always separates words here, so a text is cut at white space first and the encodings
of the pieces are kept in a bounded table for each worker: what wasn't asked for while the table
filled up once is forgotten.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import uuid
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import hold, small_batches

_END = 0x10000  # added to the last symbol of a word
PIECES = 100_000
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(kept))
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """What executors need: symbols of each entry, merges by entry, specials, and the kept pattern."""

    entries: list[str]
    names: list[str]
    halves: list[tuple[int, int]]
    usable: list[bool]
    specials: list[tuple[str, int]]
    shell: str


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file with word ends, merges in entry order, and byte-level symbols."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    suffix = model["end_of_word_suffix"]
    if model["type"] != "BPE" or not suffix or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError("a byte-level BPE vocabulary with word ends is needed")
    vocab = model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
    names = [""] * size
    entries = [""] * size
    for name, i in vocab.items():
        names[i] = name
        entries[i] = _symbols(name, suffix)
    specials = [(a["content"], a["id"]) for a in spec["added_tokens"]]
    for content, i in specials:
        names[i], entries[i] = content, ""
    halves = [(i, i) for i in range(size)]
    base = len(vocab) - len(merges)
    for rank, (a, b) in enumerate(merges):
        if vocab[a + b] != base + rank:
            raise ValueError("entries must be in merge order")
        halves[base + rank] = (vocab[a], vocab[b])
    v = Vocabulary(entries, names, halves, [bool(e) for e in entries], specials, json.dumps(_shell(spec)))
    ranks = {h: i for i, h in enumerate(halves) if h != (i, i)}
    index = {e: i for i, e in enumerate(entries) if e}
    # An entry that merging its own text doesn't give can't occur in any encoding.
    v.usable = [bool(e) and merge_by_rank(e, index, ranks) == [i] for i, e in enumerate(entries)]
    return v


def _shell(spec: dict) -> dict:
    """The file without its entries: what it does to a text before the merges."""
    parts = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
    before = {"type": "Sequence", "pretokenizers": parts}
    return spec | {"added_tokens": [], "pre_tokenizer": before, "model": spec["model"] | {"vocab": {}, "merges": []}}


def _symbols(name: str, suffix: str) -> str:
    if name.endswith(suffix) and len(name) > len(suffix):
        body = name[: -len(suffix)]
        return body[:-1] + chr(ord(body[-1]) + _END)
    return name


def merge_by_rank(word: str, index: dict[str, int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """The plain definition: merge the leftmost pair of the lowest rank until none is left."""
    ids = [index[c] for c in word]
    while len(ids) > 1:
        best, at = min((ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
        if best == 1 << 30:
            break
        ids[at : at + 2] = [best]
    return ids


class Encoder:
    """Encodes and decodes with a vocabulary; holds the tables of one worker."""

    def __init__(self, v: Vocabulary):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        self.v = v
        self.pairs = {h: i for i, h in enumerate(v.halves) if h != (i, i)}
        self.index = {e: i for i, e in enumerate(v.entries) if e and v.usable[i]}
        self.length = [len(e) for e in v.entries]
        self.machine = ahocorasick.Automaton()
        for e, i in self.index.items():
            self.machine.add_word(e, i)
        self.machine.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.bytes_of = _byte_symbols()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Up to U+02FF the letters are settled; beyond, the file's own normalizer and pattern are
        # applied, as Unicode versions differ there.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.far = re.compile("[\u0300-\U0010ffff]").search
        shell = Tokenizer.from_str(v.shell)
        self.normalized, self.cut_far = shell.normalizer.normalize_str, shell.pre_tokenizer.pre_tokenize_str
        self.cut = re.compile(rf"[^{_SPACE}]+").findall
        self.specials = re.compile("|".join(re.escape(s) for s, _ in v.specials)) if v.specials else None
        self.special_ids = dict(v.specials)
        blob = [n.encode("utf-8") for n in v.names]
        self.offsets = np.cumsum([0, *map(len, blob)])
        self.blob = np.frombuffer(b"".join(blob) + b" ", dtype=np.uint8)

    # -- encoding -------------------------------------------------------------------------

    def fits(self, a: int, b: int) -> bool:
        """Whether entries a and b may stand side by side."""
        known = self.compatible.get((a, b))
        if known is None:
            known = self.compatible[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        # Take the later of the two merges back, look at the seam, and go on until both are symbols.
        # A merge across the seam that comes before the one just taken back would have won.
        halves, bound = self.v.halves, 1 << 30
        while True:
            if self.pairs.get((a, b), 1 << 30) < bound:
                return False
            a_merged, b_merged = halves[a] != (a, a), halves[b] != (b, b)
            if a_merged and (a > b or not b_merged):
                bound, a = a, halves[a][1]
            elif b_merged:
                bound, b = b + 1, halves[b][0]
            else:
                return True

    def _shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of this one, or -1."""
        known = self.shorter.get(token)
        if known is None:
            e = self.v.entries[token]
            known = next((self.index[e[:n]] for n in range(len(e) - 1, 0, -1) if e[:n] in self.index), -1)
            self.shorter[token] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """Entries of a word given as symbols, its last one marked."""
        whole = self.index.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        longest, length = [-1] * n, self.length
        # Matches come by their ends, so the last one from a start is the longest.
        for end, token in self.machine.iter(word):
            longest[end + 1 - length[token]] = token
        open_end = [True] * (n + 1)
        out: list[int] = []
        known, last = self.compatible, -1
        at, token = 0, longest[0]
        while at < n:
            if token >= 0:
                end = at + length[token]
                if open_end[end]:
                    fit = True if last < 0 else known.get((last, token))
                    if fit is None:
                        fit = self.fits(last, token)
                    if fit:
                        out.append(token)
                        at, last = end, token
                        token = longest[at] if at < n else -1
                        continue
                token = self._shorter(token)
                continue
            # Nothing fits here: give the entry before it up.
            open_end[at] = False
            token = out.pop()
            last = out[-1] if out else -1
            at -= length[token]
            token = self._shorter(token)
        return out

    def _piece(self, piece: str) -> bytes:
        if self.specials is None or not self.specials.search(piece):
            return self._plain(piece)
        out, at = [], 0
        for m in self.specials.finditer(piece):
            out += [self._plain(piece[at : m.start()]), np.uint32(self.special_ids[m.group()]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(piece[at:])])

    def _plain(self, piece: str) -> bytes:
        if not piece:
            return b""
        low = piece.lower()
        if low.isascii() and low.isalpha():
            words = (low,)
        elif self.far(piece):
            words = [w for w, _ in self.cut_far(self.normalized(piece))]
        else:
            words = self.split(low)
        out = []
        for word in words:
            # A word of ASCII that stands alone somewhere is known as a piece; others normalize again.
            known = self.words.get(word) or (self.pieces.get(word) if word.isascii() else None)
            if known is None:
                if word.isascii() and word.isprintable():
                    raw = word
                else:
                    raw = "".join(map(self.bytes_of.__getitem__, word.encode("utf-8", "surrogatepass")))
                known = _little_endian(self.encode_word(raw[:-1] + chr(ord(raw[-1]) + _END)))
                if len(word) <= 64 and (len(words) > 1 or not word.isascii()):
                    self.words[word] = known
            out.append(known)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if len(self.pieces) > PIECES:
            self.older, self.pieces = self.pieces, {}
        if len(self.words) > PIECES:
            self.words.clear()
        if len(self.compatible) > 2 * PIECES:
            self.compatible.clear()
        pieces, older = self.pieces, self.older
        parts = text.split() if text.isascii() and not _has_separators(text) else self.cut(text)
        new = set(parts).difference(pieces)
        for p in new:
            pieces[p] = older.get(p) or self._piece(p)
        out = b"".join([pieces[p] for p in parts])
        for p in new:
            if len(p) > 200:
                del pieces[p]
        return out

    # -- decoding -------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """Names of the entries, each after the first preceded by a space, in UTF-8."""
        if not len(ids):
            return b""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size + 1)
        at = np.arange(ends[-1] - 1, dtype=np.int64)
        at += np.repeat(start - (ends - size - 1), size + 1)[:-1]
        gaps = ends[:-1] - 1
        at[gaps] = len(self.blob) - 1
        return self.blob[at].tobytes()


def _little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _has_separators(text: str) -> bool:
    """Whether str.split() would cut where the vocabulary's white space doesn't."""
    return any(c in text for c in "\x1c\x1d\x1e\x1f")


def encode_texts(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, decode: bool = True
) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded, decoded_sha256), one row for each row of docs.

    Null and empty texts have no ids and decode to an empty text. Texts of any length are encoded
    whole. Repeated rows and ids give repeated results; other columns of docs are ignored; an empty
    table gives an empty result. with_ids=False leaves out ids and decoded, decode=False the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    name = uuid.uuid4().hex

    def run(batches):
        enc = hold(name, lambda: Encoder(tables.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, ids, sha, dec, dec_sha = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    raw = enc.encode(text or "")
                    arr = np.frombuffer(raw, dtype="<u4").astype(np.int64)
                    back = enc.decode(arr)
                    n.append(len(arr))
                    sha.append(hashlib.sha256(raw).hexdigest())
                    dec_sha.append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        ids.append(arr.astype(np.int32))
                        dec.append(back.decode("utf-8") if decode else None)
                cols = [part.column("id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(dec_sha, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                    cols += [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat)), pa.array(dec, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
