"""How many tokens texts have, without giving out the tokens.

An Arrow function encodes batches that are alike in bytes, whatever rows they
come from, and keeps only lengths. Long texts are split at safe boundaries: a
place between two characters that stand side by side in no piece of the
vocabulary. Merges only ever make pieces, so none can reach over such a place,
and the counts of the parts add up to that of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from offerwatch.llm.common import stream_map, tool

LIMIT = 4096
#: Bytes that are encoded in one call.
BATCH_BYTES = 1 << 20
#: Characters after which a text is split at the next safe boundary.
PART_CHARS = 1 << 16
SPACE = "▁"


class Pieces:
    """A sentencepiece BPE model, and the pairs of characters it could join."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto()
            model.ParseFromString(file.read())
        self.first = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        written = [p.piece for p in model.pieces if p.type in (p.NORMAL, p.USER_DEFINED, p.UNUSED)]
        self.pairs = {piece[i : i + 2] for piece in written for i in range(len(piece) - 1)}
        # Parts can be encoded by themselves only where characters are kept one by one and merges decide alone.
        spec = model.normalizer_spec
        self.can_split = (
            not spec.precompiled_charsmap
            and not spec.remove_extra_whitespaces
            and not model.trainer_spec.treat_whitespace_as_suffix
            and model.trainer_spec.model_type == model.trainer_spec.BPE
            and model.trainer_spec.byte_fallback
        )
        spec.add_dummy_prefix = False  # only the first part of a text gets the space before it
        self.later = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def safe(self, text: str, at: int) -> int:
        """The first place from `at` on where nothing can join what stands on both sides; the end if there is none."""
        while at < len(text) and text[at - 1 : at + 1].replace(" ", SPACE) in self.pairs:
            at += 1
        return at

    def parts(self, text: str, chars: int) -> Iterator[tuple[bool, str]]:
        """(whether it opens the text, part) for the parts of `text`."""
        if len(text) <= chars or not self.can_split:
            yield True, text
            return
        at = 0
        while at < len(text):
            end = self.safe(text, min(at + chars, len(text)))
            yield at == 0, text[at:end]
            at = end

    def lengths(self, parts: list[tuple[bool, str]]) -> list[int]:
        out = [0] * len(parts)
        for opens, model in ((True, self.first), (False, self.later)):
            places = [i for i, part in enumerate(parts) if part[0] is opens]
            if places:
                for i, ids in zip(places, model.encode([parts[i][1] for i in places], num_threads=1), strict=True):
                    out[i] = len(ids)
        return out


class Merges:
    """A model of the tokenizers library; its rules tell no safe boundary, so texts stay whole."""

    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def parts(self, text: str, chars: int) -> Iterator[tuple[bool, str]]:
        yield True, text

    def lengths(self, parts: list[tuple[bool, str]]) -> list[int]:
        return [len(self.model.encode(text, add_special_tokens=False).ids) for _, text in parts]


def counter(path: str) -> Pieces | Merges:
    return tool(("counts", path), lambda: Pieces(path) if path.endswith(".model") else Merges(path))


def text_counts(texts: list[str | None], model: Pieces | Merges, batch_bytes: int, part_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text."""
    sizes, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    rows: list[int] = []
    parts: list[tuple[bool, str]] = []
    held = 0

    def flush():
        nonlocal held
        if parts:
            np.add.at(tokens, rows, model.lengths(parts))
        rows.clear()
        parts.clear()
        held = 0

    for row, text in enumerate(texts):
        for part in model.parts(text or "", part_chars):
            size = len(part[1].encode())
            sizes[row] += size
            rows.append(row)
            parts.append(part)
            held += size
            if held >= batch_bytes:
                flush()
    flush()
    return sizes, tokens


def counts(df: DataFrame, id_col: str, text_col: str, path: str, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES, part_chars: int = PART_CHARS) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    `path` is a sentencepiece .model or a tokenizers .json; neither begin, end
    nor added special tokens are counted, and their strings inside texts are
    what the library makes of them. Null and empty texts have no bytes and no
    tokens; every row gives one row, repeated or not, with a null id too; an
    empty table gives none; other columns of `df` are not read.

    One pass without a shuffle. A worker holds a record batch and the ids of
    `batch_bytes` of text; a text without any safe boundary is encoded whole.
    """

    def function(batches):
        model = counter(path)
        for batch in batches:
            sizes, tokens = text_counts(batch.column(1).to_pylist(), model, batch_bytes, part_chars)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    schema = f"id {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return stream_map(df.select(F.col(id_col).alias("id"), text_col), function, schema).withColumnRenamed("id", id_col)
