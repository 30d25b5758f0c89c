"""SentencePiece encoding and decoding through a table of distinct chunks.

In models whose pieces hold the whitespace marker only at their front, no merge can cross from a word into the marker
of the next. A marked text therefore splits before each run of markers into chunks whose segmentations are
independent. Each task keeps one table: a chunk is segmented by the library when first seen, later occurrences take
its ids by number, and a text's ids are put together by position. The table is bounded: a full one keeps the half that
was used most, so only rare chunks may be segmented again in a task.

A table for the whole corpus, joined back by word, would shuffle every word of every text (over ten times the input)
to save segmenting a word once for each task, so the table belongs to the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Chunks that a task's table holds at most, and characters of one batch worked on at a time.
TABLE_CHUNKS = 150_000
SLICE_CHARS = 1_000_000

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def separable(processor) -> bool:
    """Whether markers stand only at the front of the model's pieces, a marker leads each text and spaces stay."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    inside = re.compile(f"[^{MARK}]{MARK}")
    return not any(inside.search(p) for p in pieces) and processor.encode("  a ", out_type=str)[0].startswith(MARK) and processor.decode(processor.encode("  a ")) == "  a "


class ChunkTable:
    """Numbered chunks with their ids and decoded text."""

    def __init__(self, processor, limit: int = TABLE_CHUNKS):
        self.processor, self.limit = processor, limit
        self.number: dict[str, int] = {}
        self.decoded: list[str] = []
        self.start, self.ids = [0], np.empty(0, np.int32)
        self.uses = np.empty(0, np.int64)

    def shrink(self) -> None:
        """Keeps the half of the table that was used most."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.limit // 2])
        chunks, start = list(self.number), np.asarray(self.start, np.int64)
        length = np.diff(start)[kept]
        self.start = [0, *np.cumsum(length).tolist()]
        self.ids = self.ids[np.arange(length.sum()) + np.repeat(start[kept] - np.cumsum(length) + length, length)]
        self.number = {chunks[k]: i for i, k in enumerate(kept.tolist())}
        self.decoded = [self.decoded[k] for k in kept.tolist()]
        self.uses = self.uses[kept]

    def add(self, chunks: list[str]) -> None:
        """Segments chunks that aren't in the table yet. The library puts a marker in front, so each goes without its first."""
        found = self.processor.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        # a chunk that is one bare marker is an empty text to the library, which gives it no marker: ask for its piece
        bare = self.processor.piece_to_id(MARK)
        found = [ids or [bare] for ids in found]
        for c, ids, text in zip(chunks, found, self.processor.decode(found), strict=True):
            self.number[c] = len(self.decoded)
            # decoding drops one leading space of a text: within a text it stays
            self.decoded.append(" " + text)
            self.start.append(self.start[-1] + len(ids))
        self.ids = np.concatenate([self.ids, *(np.asarray(x, np.int32) for x in found)])
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts one after another, where each text's begin (one more than texts), and the decoded texts."""
        split = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list(dict.fromkeys(c for chunks in split for c in chunks if c not in self.number))
        if new:
            if len(self.number) + len(new) > self.limit and self.number:
                self.shrink()
                new = list(dict.fromkeys(c for chunks in split for c in chunks if c not in self.number))
            self.add(new)
        number, decoded = self.number, self.decoded
        codes = [[number[c] for c in chunks] for chunks in split]
        back = ["".join([decoded[k] for k in x])[1:] for x in codes]
        flat = np.fromiter((k for x in codes for k in x), np.int64, sum(map(len, codes)))
        self.uses += np.bincount(flat, minlength=len(self.uses))
        start = np.asarray(self.start, np.int64)
        length = np.diff(start)[flat]
        ends = np.cumsum(length)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[flat] - ends + length, length)]
        places = np.concatenate([[0], ends])[np.cumsum([0, *map(len, codes)])]
        return ids, places.astype(np.int64), back


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = TABLE_CHUNKS) -> DataFrame:
    """``docs`` with piece_ids (array of the library's ids, no begin or end) and decoded (the library's text of them).

    ``model_path`` is a file that every executor can open. Models whose pieces may cross whitespace are refused.

    Null and empty texts have no ids and decode to the empty text. Texts of any length are taken whole; repeated rows
    and null ids are kept. An empty table gives no rows. Other columns stay; those named piece_ids or decoded are replaced.
    """
    made = ("piece_ids", "decoded")
    base = docs.drop(*(x for x in made if x != text_col))
    at = base.columns.index(text_col)
    schema = T.StructType([*base.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if not separable(processor):
            raise ValueError("pieces of this model may cross whitespace: its texts can't be segmented by chunks")
        table = ChunkTable(processor, limit)
        for batch in batches:
            for part in slices(batch, at, SLICE_CHARS):
                texts = [t or "" for t in part.column(at).to_pylist()]
                ids, places, back = table.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(back, pa.string())], names=[*part.schema.names, *made])

    return base.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of about ``most`` bytes in the given text column, or one row."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop
