"""Which texts hold which passages: one automaton of all passages, and one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.sources.shared import stored, text_batches

#: Passages and their characters in one automaton; more of them take another pass.
MOST_PASSAGES, MOST_CHARS = 50_000, 1 << 25


def _automatons(passages: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The passages in parts that fit one automaton, a part at a time on the driver."""
    part: list[tuple] = []
    size = 0
    for r in passages.select(key, text).filter(F.col(text).isNotNull()).toLocalIterator():
        if part and (len(part) == MOST_PASSAGES or size + len(r[1]) > MOST_CHARS):
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    yield part


def holding(texts: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text", passage_key: str = "query_id", passage: str = "query") -> DataFrame:
    """passage_key, key: each pair of a text and a passage that it holds, letter for letter, once a row of `texts`.

    Null texts hold nothing, null passages are nowhere; an empty passage is in every text. Passages that are alike are each found. Up to
    MOST_PASSAGES passages of MOST_CHARS characters are one pass over the texts, which is run when this is called; what it finds is
    written to the shared folder."""
    schema = T.StructType([T.StructField(passage_key, passages.schema[passage_key].dataType), T.StructField(key, texts.schema[key].dataType)])
    found = None
    for part in _automatons(passages, passage_key, passage):

        def search(batches: Iterator[pa.RecordBatch], part: list[tuple] = part) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            by_text: dict[str, list] = {}
            for name, words in part:
                by_text.setdefault(words, []).append(name)
            everywhere = by_text.pop("", [])
            automaton = ahocorasick.Automaton()
            for words, names in by_text.items():
                automaton.add_word(words, names)
            automaton.make_automaton()
            for batch in batches:
                keys, out_names, out_places = batch.column(0), [], []
                for i, value in enumerate(batch.column(1)):
                    words = value.as_py()
                    if words is None:
                        continue
                    hits = {id(names): names for _, names in automaton.iter(words)} if by_text else {}
                    for names in [everywhere, *hits.values()]:
                        out_names += names
                        out_places += [i] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(out_names, arrow), keys.take(pa.array(out_places, pa.int64()))], schema.names)

        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(schema[passage_key].dataType)
        with text_batches(texts.sparkSession):
            one = stored(texts.select(key, text).mapInArrow(search, schema), "holding")
        found = one if found is None else found.unionByName(one)
    return found
