"""The corpus operators' registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_byte_bpe
from .jaccard import op10_ngram_jaccard_join
from .langid import op6_language_id
from .lengths import op8_token_counts
from .packing import op3_best_fit_packing
from .pii import op9_surrogates
from .quality import op4_quality_rules
from .sharding import op7_hilbert_sharding
from .spotsigs import op1_spotsigs
from .urls import op5_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_spotsigs,
        op2_byte_bpe,
        op3_best_fit_packing,
        op4_quality_rules,
        op5_url_filters,
        op6_language_id,
        op7_hilbert_sharding,
        op8_token_counts,
        op9_surrogates,
        op10_ngram_jaccard_join,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op10_ngram_jaccard_join": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), places as (
  select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0
), shingles as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from places
), sizes as (
  select doc_id, count(*) as n from shingles group by 1
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), reached as (
  select doc_id, doc_id as other from documents union select reached.doc_id, b from reached join links on a = other
)
select d.doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id from documents d left join sizes using (doc_id) join reached using (doc_id) group by 1
""",
}
