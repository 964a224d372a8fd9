"""K1: extractors of single sites as plug-ins: a function from Arrow batches of pages to Arrow batches of rows, chosen by site key.

Rules (``rules.Sites``) cover sites whose pages differ by selectors only. A site that needs code of its own brings a function; all sites
are served in one pass, each page is handed to its site's function once, and no page is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from serialake.operators import nodes
from serialake.rules import Rule

#: Pages of one site in, rows of the agreed schema out (any number per page).
Extractor = Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]]


def extract_by_site(pages: DataFrame, extractors: Mapping[str, Extractor], schema: str, *, site: str = "site_key", columns: Iterable[str] | None = None) -> DataFrame:
    """Rows that the extractor of each page's site makes; pages of other sites (or of none) make no rows.

    ``columns`` are what extractors see of a page (all, if not given), beside the site. A result has the columns of ``schema``; another
    order is put right and types are cast, a missing column stops the job with its site's name.
    """
    shape, known = to_arrow_schema(T._parse_datatype_string(schema)), dict(extractors)

    def fitted(key: str, made: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if missing := [n for n in shape.names if n not in made.schema.names]:
            raise ValueError(f"extractor of {key}: no column {missing}")
        yield from pa.Table.from_batches([made]).select(shape.names).cast(shape).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.num_columns - 1)
            for key in pc.unique(keys).to_pylist():
                if key not in known:
                    continue
                made = known[key](batch.filter(pc.equal(keys, key)).drop_columns(["__site"]))
                for part in [made] if isinstance(made, pa.RecordBatch) else made:
                    yield from fitted(key, part)

    seen = pages.select(*(columns or pages.columns), pages[site].alias("__site"))
    return seen.mapInArrow(run, schema)


def rule_extractor(rules: Iterable[Rule], *, page_id: str = "page_id", html: str = "html", noise: Iterable[str] = ("script", "style")) -> Extractor:
    """An extractor made of rules: page, field, pos, text, href of every match; for sites that mix rules with code."""
    plain, noise = nodes.plain_rules(list(rules)), tuple(noise)

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column(page_id).to_pylist(), batch.column(html).to_pylist())
        rows = [(page, e["field"], e["pos"], e["text"], e["href"]) for page, text in pairs for e in nodes.walk(text, plain, noise)]
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [batch.schema.field(page_id).type, pa.string(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], [page_id, "field", "pos", "text", "href"])
    return extract
