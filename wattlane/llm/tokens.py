"""Token counts by a whole-token shortcut (operator 10) and the piece
encoder that packing (operator 9) shares.

Method. A text is cut at white space into units: a run of non-space with at
most one space before it, or white space. The tokenizer's own pre-tokens
never cross such a cut, so a text's ids are its units' ids in order.
Offline, ``prove_whole`` finds the vocabulary strings that the merges really
turn into that one token (a string can be in the vocabulary and still be
reached by other merges). A pre-token that is such a string counts as one
token with no merging; only the other pre-tokens go through the merges.
Both kinds are remembered per unit, so a frequent word costs one lookup.

Texts that contain the string of an added token go whole through the
library, whose default handles them. Null texts are empty.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import portions

# The white space of the tokenizer's pre-token pattern, and that pattern.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
_PRE = regex.compile(PRETOKEN)
CACHE = 400_000
# Below this code point all Unicode versions agree on letters, numbers and white space.
SETTLED = "\u0500"


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet, letter -> byte: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def prove_whole(tok) -> dict[str, int]:
    """string -> id for the vocabulary strings that encode alone as exactly
    their own token. Bounded by the vocabulary."""
    added = {t.content for t in tok.get_added_tokens_decoder().values()}
    ids = sorted(i for s, i in tok.get_vocab(with_added_tokens=False).items() if s not in added)
    texts = tok.decode_batch([[i] for i in ids], skip_special_tokens=False)
    found = tok.encode_batch(texts, add_special_tokens=False)
    return {t: i for t, i, e in zip(texts, ids, found) if e.ids == [i]}


def merge_engine(tok):
    """The merges as a rank table (tiktoken), which is several times faster
    a pre-token than an encode call; None where the file does not allow it.

    A rank table joins any two neighbours that spell a token, the file only
    the listed pair. Both agree once the tokens that do not encode as
    themselves are left out: a proven token has one last pair. Needed for
    that, and checked: ids rise in merge order, after the single bytes.
    """
    import json

    import tiktoken

    model = json.loads(tok.to_str())["model"]
    vocab, merges = model["vocab"], model["merges"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    letters = byte_letters()
    base = [vocab.get(c, -1) for c in letters]
    if made != sorted(made) or min(base) < 0 or max(base) >= min(made, default=0):
        return None
    ranks = {bytes(letters[c] for c in s): i for s, i in vocab.items()
             if all(c in letters for c in s) and [t.id for t in tok.model.tokenize(s)] == [i]}
    return tiktoken.Encoding("merges", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class UnitEncoder(dict):
    """Units of a text to values (a count, or id bytes), remembered: the
    dictionary itself, which learns a unit when it first meets it.

    ``value(ids)`` turns ids into what is kept for a unit; values of the
    pre-tokens of a unit are added up with ``+``. Above ``CACHE`` units all
    but the proven ones are forgotten.
    """

    def __init__(self, path: str, value: Callable, whole: dict[str, int] | None = None):
        self.tok = load_tokenizer(path)
        self.value = value
        whole = prove_whole(self.tok) if whole is None else whole
        self.whole = {s: value([i]) for s, i in whole.items()}
        self.merge = merge_engine(self.tok) or self._library
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        super().__init__(self.whole)

    def _library(self, pretoken: str) -> list[int]:
        return self.tok.encode(pretoken, add_special_tokens=False).ids

    def _pretokens(self, unit: str) -> list[str]:
        if unit.isascii() or max(unit) < SETTLED:
            if (unit[1:] if unit[0] == " " else unit).isalpha():
                return [unit]  # one word
            return _PRE.findall(unit)
        # later letters and numbers: the library's own classes decide
        return [unit[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(unit)]

    def __missing__(self, unit: str):
        total = None
        for p in self._pretokens(unit):
            v = self.get(p)  # whole tokens, and words met before
            if v is None:
                v = self.value(self.merge(p))
            total = v if total is None else total + v
        if len(self) >= CACHE:
            self.clear()
            self.update(self.whole)
        self[unit] = total
        return total

    def units(self, text: str) -> list | None:
        """The values of a text's units in order; None where only the
        library's whole-text encoding is right (added tokens inside)."""
        if self.added and self.added.search(text):
            return None
        return list(map(self.__getitem__, UNIT.findall(text)))

    def whole_text(self, text: str):
        return self.value(self.tok.encode(text, add_special_tokens=False).ids)


_ENCODERS: dict = {}


def encoder(path: str, value: Callable, whole: dict[str, int]) -> UnitEncoder:
    """One encoder a worker process: the tasks that follow find its units."""
    key = (path, value.__name__)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(path, value, whole)
    return _ENCODERS[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (``n_tokens > limit``), one row
    per input row. Null text: 0 bytes, 0 tokens. One pass, no shuffle."""
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(load_tokenizer(tokenizer_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, len, whole.value)
        for b in portions(batches):
            out = []
            for text in b.column("text").to_pylist():
                if not text:
                    out.append(0)
                    continue
                units = enc.units(text)
                out.append(enc.whole_text(text) if units is None else sum(units))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(out, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    src = docs.select(F.col("doc_id").cast("long"), "text",
                      F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
