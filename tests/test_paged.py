"""Reading by pages: caps, repeated cursors, and a stream that reads each page once over a restart."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from carelake.sources import paged as P


class Folder:
    """A service of JSON pages in a folder, which notes what is fetched for records."""

    def __init__(self, home, loop=False):
        self.home, self.loop = str(home), loop

    def resources(self):
        return sorted(p.name for p in Path(self.home).iterdir() if p.is_dir())

    def fetch(self, resource, token):
        pages = sorted(Path(self.home, resource).glob("*.json"))
        at = int(token or 0)
        if at >= len(pages):
            return [], None
        following = str(at + 1) if at + 1 < len(pages) else " "
        return json.loads(pages[at].read_text()), "1" if self.loop and at == 1 else following


@pytest.fixture()
def home(tmp_path):
    for name, sizes in {"a": [3, 2, 4], "b": [5], "c": [0, 1]}.items():
        (tmp_path / "pages" / name).mkdir(parents=True)
        for i, n in enumerate(sizes):
            (tmp_path / "pages" / name / f"{i}.json").write_text(json.dumps([f"{name}{i}{k}" for k in range(n)]))
    return tmp_path / "pages"


def _read(spark, client, **options):
    df = spark.read.format(P.paged(spark, client, "pages")).options(**options).load()
    rows = df.collect()
    held = spark.createDataFrame(rows, df.schema)
    return {r: sorted(x["record"] for x in P.records(held).where(F.col("resource") == r).collect()) for r in client.resources()}, {r[0]: tuple(r)[1:] for r in P.results(held).collect()}


def test_all_pages_of_all_resources(spark, home):
    records, results = _read(spark, Folder(home))
    assert [len(records[r]) for r in "abc"] == [9, 5, 1]
    assert results == {"a": (9, 3, False, None), "b": (5, 1, False, None), "c": (1, 2, False, None)}


@pytest.mark.parametrize(
    "items, pages, want",
    [
        (5, 9, {"a": (5, 2, True, P.ITEM_LIMIT), "b": (5, 1, False, None)}),
        (4, 9, {"a": (4, 2, True, P.ITEM_LIMIT), "b": (4, 1, True, P.ITEM_LIMIT)}),
        (99, 2, {"a": (5, 2, True, P.PAGE_LIMIT), "b": (5, 1, False, None)}),
    ],
)
def test_caps_say_that_something_is_left(spark, home, items, pages, want):
    records, results = _read(spark, Folder(home), maxItems=items, maxPages=pages)
    assert {r: results[r] for r in "ab"} == want and {r: len(records[r]) for r in "ab"} == {r: want[r][0] for r in "ab"}


def test_a_repeated_cursor_ends_the_reading(spark, home):
    assert _read(spark, Folder(home, loop=True))[1]["a"] == (5, 2, True, P.REPEATED)
    with pytest.raises(Exception, match="maxItems must be positive"):
        _read(spark, Folder(home), maxItems=0)


def test_a_restarted_stream_goes_on_behind_the_last_page(spark, home, tmp_path):
    client = Folder(home)

    def run():
        stream = spark.readStream.format(P.paged(spark, client, "pages")).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["record"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    pages = sorted(home.joinpath("a").glob("*.json"))
    later = pages[2].rename(tmp_path / "later.json")
    assert len(run()) == 3 + 2 + 5 + 0 + 1
    assert len(run()) == 11  # nothing new, nothing twice
    later.rename(pages[2])  # a page behind the end of a resource that ended comes too late
    found = run()
    assert len(found) == len(set(found)) == 11


def test_a_stream_that_stops_between_pages_reads_each_page_once(spark, home, tmp_path):
    seen, client = [], Folder(home)
    for n in (1, 2, 3, 4):
        stream = spark.readStream.format(P.paged(spark, client, "pages")).load()
        writer = stream.writeStream.foreachBatch(lambda df, i: seen.append((i, [r["record"] for r in df.collect()]))).option("checkpointLocation", str(tmp_path / "checkpoint"))
        query = writer.trigger(once=True).start()
        assert query.awaitTermination(60)
    records = [r for _, held in seen for r in held]
    assert len(records) == len(set(records)) == 15 and len({i for i, _ in seen}) == 3
