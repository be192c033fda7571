"""Token counts by a public tokenizer: texts go through Arrow in batches, only lengths come back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_buffer, tidy

#: Bytes of chunks that are encoded in one call, and chunks that a worker remembers.
GROUP_BYTES, REMEMBERED = 1_000_000, 400_000
#: Chunks longer than this are cut further where no piece of the vocabulary spans the cut.
LONG_CHUNK = 4096
_CHUNK = re.compile(" *[^ ]+| +$")


class PieceCounter:
    """Counts sentencepiece BPE tokens of texts exactly, from cuts that no piece can span.

    In the vocabulary the space sign only leads a piece, so no merge crosses the place between a character
    and a following space, and each run of spaces with the word after it is encoded by itself. The encoder
    puts one space before any input, which stands for the chunk's own first space. Chunks recur, so their
    lengths are remembered; new ones are encoded in groups of about equal bytes.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space after a character: spaces are no safe cuts")
        self.spanned = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.known: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.known[""] = len(self.model.encode("a ")) - len(self.model.encode("a"))  # one space that ends a text

    def chunks(self, text: str) -> list[str]:
        text = text.replace("▁", " ")  # the encoder reads both alike
        if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
            return text.split(" ")
        parts = _CHUNK.findall(text)
        return parts[:1] + [p[1:] for p in parts[1:]]

    def _pieces_of(self, chunk: str) -> list[str]:
        """A long chunk in parts that are encoded apart; all but the first lose the space put before them."""
        cuts = [0]
        for i in range(1, len(chunk)):
            if i - cuts[-1] >= LONG_CHUNK and chunk[i - 1 : i + 1] not in self.spanned and chunk[i] != " " and chunk[i - 1] != " ":
                cuts.append(i)
        return [chunk[a:b] for a, b in zip(cuts, [*cuts[1:], len(chunk)], strict=True)]

    def _learn(self, new: list[str]) -> None:
        group, held = [], 0
        for chunk in new:
            if len(chunk) > LONG_CHUNK:
                self.known[chunk] = self._long(chunk)
                continue
            group.append(chunk)
            held += len(chunk.encode("utf-8", "surrogatepass"))
            if held >= GROUP_BYTES:
                self._encode(group)
                group, held = [], 0
        self._encode(group)

    def _encode(self, group: list[str]) -> None:
        if group:
            self.known.update(zip(group, map(len, self.model.encode(group, num_threads=1)), strict=True))

    def _long(self, chunk: str) -> int:
        first, *rest = self._pieces_of(chunk)
        total = len(self.model.encode(first))
        for part in rest:
            # "\n" is a byte token, which no merge joins, so what follows it is encoded without a leading space
            total += len(self.model.encode("\n" + part)) - self.bare
        return total

    @property
    def bare(self) -> int:
        return len(self.model.encode("\n"))

    def count(self, texts: list[str | None], sizes: list[int] | None = None) -> list[int]:
        """Tokens of each text; sizes are their bytes, by which texts go in groups."""
        sizes = sizes or [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        out, i = [], 0
        while i < len(texts):
            group, held = [], 0
            while i < len(texts) and (not group or held < 4 * GROUP_BYTES):
                held += sizes[i]
                group.append(self.chunks(texts[i]) if texts[i] else [])
                i += 1
            if len(self.known) > REMEMBERED:
                self.forget()
            self._learn(sorted(set().union(*group) - self.known.keys()))
            out += [sum(map(self.known.__getitem__, parts)) for parts in group]
        return out


_counters: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    if model_file not in _counters:
        _counters[model_file] = PieceCounter(model_file)
    return _counters[model_file]


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: its id, n_bytes of UTF-8, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are kept as they are; other
    columns of docs, whatever their names, are left out. Nothing is shuffled: each row is counted where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counter(model_file)
        for batch in batches:
            _, offs = text_buffer(batch.column(1))
            sizes = np.diff(offs)
            n = np.asarray(encoder.count(batch.column(1).to_pylist(), sizes.tolist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    ids = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = ids.schema["id"].dataType.simpleString()
    return ids.mapInArrow(tidy(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
