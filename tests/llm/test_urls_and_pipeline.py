"""URL rules and trees, and the pipeline from end to end."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from spindrift.llm import jaccard, urls
from spindrift.llm.common import table

SF = "/root/testdata/sf0.001"


def plain(url):
    url = url or ""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    odd = [None, "", "no scheme", "http://", "http://ORG/x", "https://a.Example.ORG/es/1?q=1#f", "ftp://example.org/en/12", "http://xorg/", "http://x.com/fr/?a", "http://x.com", "http://x.net/a/b?x=1&y=2://z", "http://münchen.com/de/ü", "http://user@host.org:80/es/"]
    df = spark.createDataFrame([(i, u, "clash", 3) for i, u in enumerate(odd)], "page_id long, url string, host string, features int")
    for r in urls.judge(df).collect():
        host, path, rule, verdict = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urls.judge(df.where("false").select("page_id", "url")).count() == 0
    one = urls.judge(df.where("page_id in (4, 10)").select("page_id", "url")).collect()
    assert {r.verdict for r in one} == {"allow"}  # only one label is known


def test_trees_learn_what_sets_urls_apart(spark):
    rows = [(f"http://h{i}.com/fr/{'a' * (i % 7)}",) for i in range(200)] + [(f"http://h{i}.com/de/{i}{i}{i}{i}?a=1&b=2",) for i in range(200)]
    unseen = [(f"http://h{i}.net/x/{'b' * (i % 7)}",) for i in range(50)] + [(f"http://h{i}.net/x/{i}{i}{i}{i}?a=1&b=2",) for i in range(50, 100)]
    found = urls.judge(spark.createDataFrame(rows + unseen, "url string")).where("rule is null").collect()
    assert sum((r.verdict == "block") == ("?" in r.url) for r in found) >= 95


def test_query_judges_every_page(spark):
    found = urls.op5_url_filters(spark, SF).collect()
    pages = {r.page_id: r.url for r in table(spark, SF, "pages").collect()}
    assert sorted(r.page_id for r in found) == sorted(pages)
    assert all((r.host, r.path, r.rule) == plain(pages[r.page_id])[:3] for r in found)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns, read again from Parquet."""
    docs, out = table(spark, SF, "documents"), []
    extra = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "12 34", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages(stages):
    for before, after in stages[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS
    (docs, told), (_, good), (_, single), (_, private), (last, packed) = stages
    gone = {r.doc_id for r in docs.join(told, "doc_id", "left_anti").collect()}
    assert gone == {900, 901, 902}
    texts = [r.text for r in single.collect()]
    assert len(set(texts)) == len(texts) <= good.count()
    assert private.count() == single.count() and not private.where(F.col("text").rlike(r"AKIA[A-Z0-9]{16}")).join(single.where(F.col("text").rlike(r"AKIA[A-Z0-9]{16}")), "text").count()
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in last.collect()}


def test_stages_of_odd_tables(spark):
    """Repeated ids, rows that repeat, null ids, clashing names; and nothing at all."""
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, SF, "documents").where("lang = 'en'").orderBy("doc_id").limit(40).collect()]
    a, b = base[0][1] + " first", base[1][1] + " second"
    rows = [*base, (70, a, "en", "s", 1), (70, b, "en", "s", 1), (70, a, "en", "r", 1), (None, a, "en", "s", 1), (71, base[2][1], "en", "s", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "clash", 1.0, 3, 4) for r in rows], f"{kind}, kept string, score double, key int, __words int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), kind) if name != "near_duplicates" else docs
        if name == "near_duplicates":
            found = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
            near = jaccard.join_components(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"))
            kept_texts = {r.text for r in found}
            assert len([r for r in found if r.doc_id is None]) == len([r for r in docs.collect() if r.doc_id is None])
            assert len([r for r in found if r.doc_id is not None]) == near.join(docs.where("doc_id is not null").select(F.xxhash64("doc_id", "text").alias("doc_id")).distinct(), "doc_id").select("component_id").distinct().count()
            assert len(kept_texts) <= len({r.text for r in docs.collect()}) and 71 not in {r.doc_id for r in found}
    nothing = docs.where("false")
    assert all(stage(spark, nothing, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(corpus_pipeline.STAGES) == 5
