"""Sources that read parts of files, a hub of datasets, and walks over links."""

from __future__ import annotations

import gzip
import io
import json
import random
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import walk, web
from corpusloom.sources import hub, ranges


class Counting(io.BytesIO):
    count = 0

    def read(self, n=-1):
        data = super().read(n)
        self.count += len(data)
        return data


def test_windows_hold_each_line_once():
    rng = random.Random(5)
    for ending in (b"", b"\n"):
        data = b"\n".join(b"x" * rng.choice([0, 0, 1, 2, 7, 40]) for _ in range(60)) + ending
        want, at = [], 0
        for line in data.removesuffix(b"\n").split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        for size in (1, 2, 3, 7, 50, 10_000):
            for chunk in (1, 5, 4096):
                got = [x for a in range(0, len(data), size) for x in ranges.lines_between(io.BytesIO(data), a, min(a + size, len(data)), chunk)]
                assert got == want
    assert list(ranges.lines_between(io.BytesIO(b""), 0, 0)) == []


def test_a_window_reads_its_own_bytes():
    data = b"".join(b"%06d\n" % i for i in range(1_000_000))
    f = Counting(data)
    assert len(list(ranges.lines_between(f, 3_500_000, 3_600_000))) == pytest.approx(100_000 / 7, abs=1)
    assert f.count < 120_000


def test_read_windows(spark, tmp_path):
    lines = [json.dumps({"n": i, "pad": "é" * (i % 50)}, ensure_ascii=False) for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:2000]) + "\n")
    (tmp_path / "b.jsonl").write_bytes("\r\n".join(lines[2000:2500]).encode())
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as g:
        g.write("\n".join(lines[2500:]))
    (tmp_path / "_SUCCESS").write_text("")
    for path in (str(tmp_path), f"file://{tmp_path}", [str(tmp_path / n) for n in ("a.jsonl", "b.jsonl", "c.jsonl.gz")]):
        rows = ranges.read_windows(spark, path, windowBytes=4000)
        assert sorted(r.value for r in rows.collect()) == sorted(lines)
        assert rows.rdd.getNumPartitions() > 20
    assert [r.offset for r in ranges.read_windows(spark, str(tmp_path / "a.jsonl"), windowBytes=100).orderBy("offset").limit(2).collect()] == [0, len(lines[0].encode()) + 1]
    some = ranges.read_windows(spark, str(tmp_path / "a.jsonl"), windows=10, takeBytes=500)
    size = (tmp_path / "a.jsonl").stat().st_size
    got = [r.offset for r in some.collect()]
    starts = [i * size // 10 for i in range(10)]
    nearest = [max(a for a in starts if a <= o) for o in got]
    assert set(nearest) == set(starts) and all(o - a < 500 for o, a in zip(got, nearest, strict=True)) and len(got) < 120
    (tmp_path / "none").mkdir()
    assert ranges.read_windows(spark, str(tmp_path / "none")).count() == 0


def test_archives_by_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"d/m{i}.jsonl", "".join(f'{{"i": {i}, "k": {k}}}\n\n' for k in range(50)))
        z.writestr("t.txt", "one\r\ntwo")
        z.writestr("z.jsonl.gz", gzip.compress(b'{"x": 1}\n'))
        z.writestr("d/skip.bin", "no")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    rows = ranges.read_archives(spark, str(tmp_path), partitionBytes=1000)
    assert rows.rdd.getNumPartitions() > 3
    got = {(r.member, r.line): r.value for r in rows.collect()}
    assert len(got) == 40 * 50 + 3 and got["d/m7.jsonl", 4] == '{"i": 7, "k": 2}' and got["t.txt", 0] == "one" and got["z.jsonl.gz", 0] == '{"x": 1}'


def test_hub(spark, tmp_path):
    def put(name: str, values: list, append: bool = False) -> None:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with open(path, "a" if append else "w") as f:
            f.writelines((v if isinstance(v, str) else json.dumps(v)) + "\n" for v in values)

    put("o/a/hi/1.jsonl", [{"text": "  first text  "}, {"text": "short"}, {"no": 1}, "{broken", "[1]", {"text": None}])
    put("o/b/verified/hi/1.jsonl", [{"body": "second text"}])
    put("o/walled/hi/1.jsonl", [{"text": "third text"}])
    codes = {"hindi": "hi"}
    specs = [hub.Spec("a", "o/a", codes), hub.Spec("b", "o/b", codes, "data_dir", "verified/{code}", "body"), hub.Spec("w", "o/walled", codes, gated=True), hub.Spec("s", "o/s", codes, needs_trust=True), hub.Spec("l", "o/lost", codes), hub.Spec("n", "o/n", {})]
    root, least = str(tmp_path), {"minChars": 8}
    assert sorted(r.text for r in hub.read_hub(spark, root, specs, "hindi", **least).collect()) == ["first text", "second text"]
    assert sorted(r.text for r in hub.read_hub(spark, root, specs, "hindi", accepted="o/walled", **least).collect()) == ["first text", "second text", "third text"]
    report = {r.source: (r.status, (r.error or "").split()[:1]) for r in hub.hub_report(spark, root, specs, "hindi").collect()}
    assert report == {"a": ("ok", []), "b": ("ok", []), "w": ("load_failed", ["gated:"]), "s": ("load_failed", ["needs"]), "l": ("load_failed", ["not"]), "n": ("unavailable_for_language", [])}
    assert hub.read_hub(spark, root, specs, "nepali").count() == 0

    def go_on() -> list[str]:
        query = hub.stream_hub(spark, root, specs, "hindi", **least).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        return sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert go_on() == ["first text", "second text"]
    put("o/a/hi/1.jsonl", [{"text": "appended text"}], append=True)
    put("o/a/hi/2.jsonl", [{"text": "new file text"}])
    want = sorted(r.text for r in hub.read_hub(spark, root, specs, "hindi", **least).collect())
    assert go_on() == want and len(want) == 4
    assert go_on() == want


def queue_walk(pages: dict[str, list[str]], seeds: list[str], depth: int) -> tuple[dict, set]:
    seen, files, queue = {s: (0, None) for s in seeds}, set(), deque((s, 0) for s in seeds)
    while queue:
        url, d = queue.popleft()
        if d >= depth:
            continue
        for link in pages.get(url, []):
            if link.endswith(".pdf"):
                files.add(link)
            elif link not in seen and link.split("/")[2] == url.split("/")[2]:
                seen[link] = (d + 1, url)
                queue.append((link, d + 1))
    return seen, files


def test_page_walk_is_a_queues_walk(spark):
    rng = random.Random(6)
    urls = [f"https://h{i % 2}.x/{i}" for i in range(60)]
    links = {u: [rng.choice([*urls, "https://h0.x/gone", f"https://f.x/{rng.randint(0, 5)}.pdf"]) for _ in range(rng.randint(0, 4))] for u in urls}
    pages = spark.createDataFrame([(u, "".join(f'<a href="{x}#f">' for x in ls)) for u, ls in links.items()] + [(None, "x"), (urls[5], None)], "url string, html string")
    pages = pages.filter(F.col("html").isNotNull() | F.col("url").isNull())
    seeds = [urls[3], urls[8], urls[3]]
    for depth in (0, 1, 3, 9):
        seen, files = queue_walk(links, list(dict.fromkeys(seeds)), depth)
        got = walk.page_walk(pages.repartition(3), spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "url string, place long"), depth).collect()
        assert {r.url: (r.depth, r.parent) for r in got if r.kind == "page"} == seen
        assert {r.url for r in got if r.kind == "pdf"} == files and len(got) == len(seen) + len(files)
        assert all(r.fetched == (r.url in links) for r in got if r.kind == "page")
    few = walk.page_walk(pages, spark.createDataFrame([(urls[0], 0), (urls[1], 1)], "url string, place long"), 9, per_host=3).filter("kind = 'page'")
    assert {r.host: r.n for r in few.groupBy(web.authority(F.col("url")).alias("host")).agg(F.count("*").alias("n")).collect()} == {"h0.x": 3, "h1.x": 3}
    assert walk.page_walk(pages.limit(0), spark.createDataFrame([], "url string, place long"), 3).count() == 0


def test_sitemap_walk_limits(spark):
    index = lambda *to: "<sitemapindex>" + "".join(f"<loc>{t}</loc>" for t in to) + "</sitemapindex>"
    urls = lambda *to: "<urlset>" + "".join(f"<loc>{t}</loc>" for t in to) + "</urlset>"
    maps = [("r", index("b", "a", "r")), ("a", urls("http://1", "http://2")), ("b", index("c")), ("c", urls("http://2", "http://3", "http://4"))]
    df = spark.createDataFrame(maps, "url string, xml string")
    starts = spark.createDataFrame([("o", "r", 0), ("o", "missing", 1), ("p", "c", 0)], "origin string, node string, place long")
    rows = lambda **k: {(r.origin, r.url, r.map, r.depth) for r in walk.sitemap_walk(df, starts, **k).collect()}
    p = {("p", f"http://{i}", "c", 0) for i in (2, 3, 4)}
    assert rows() == p | {("o", "http://1", "a", 1), ("o", "http://2", "a", 1), ("o", "http://3", "c", 2), ("o", "http://4", "c", 2)}
    assert rows(max_maps=4) == p | {("o", "http://1", "a", 1), ("o", "http://2", "a", 1)}
    assert {r for r in rows(max_urls=1)} == {("o", "http://1", "a", 1), ("p", "http://2", "c", 0)}
    robots = spark.createDataFrame([("User-agent: *\n sitemap: http://x/a.xml \r\nSitemap:http://y\nno",), (None,)], "t string")
    assert [r[0] for r in robots.select(walk.robots_sitemaps(F.col("t"))).collect()] == [["http://x/a.xml", "http://y"], None]


def test_sitemaps_with_prefixed_elements(spark):
    xml = ['<?xml version="1.0"?><!-- c --><sm:urlset xmlns:sm="s"><sm:url><sm:loc> http://a?x=1&amp;y=2 </sm:loc></sm:url></sm:urlset>', "<sm:sitemapindex><sm:sitemap><sm:loc>http://m</sm:loc></sm:sitemap></sm:sitemapindex>", "<other/>", ""]
    children, urls = web.sitemap(F.col("x"))
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xml)], "i int, x string").select("i", children, urls).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [([], ["http://a?x=1&y=2"]), (["http://m"], []), ([], []), ([], [])]
