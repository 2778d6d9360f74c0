"""Wrappers are counted over all pages of a host, in any order and deal of rows."""

import random

from featureops.llm import wrappers

COMMON = '<html><body><div class="top">Menu one</div><div class="wrap"><h2>Title {0}</h2><p>Story number {0} of the usual layout, which is long.</p></div></body></html>'
RARE = '<html><body><div class="bar">Menu two</div><div class="box"><p>Letter {0} of the seldom layout.</p></div><div class="end">About us</div></body></html>'


def rows_of():
    rows = [(i, f"http://big.org/{i}", COMMON.format(i)) for i in range(200)]
    rows += [(1000 + i, f"http://big.org/l{i}", RARE.format(i)) for i in range(6)]
    rows += [(2000 + i, f"http://copies.org/{i}", RARE.format(0)) for i in range(20)]
    rows += [(3000 + i, f"http://odd.org/{i}", RARE.format(i).replace("About us", f"All that is to be known about {'them' if i == 30 else 'us'}")) for i in range(40)]
    return rows


def test_a_layout_of_few_pages_is_known(spark):
    rows = rows_of()
    got = {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"Title {i}\n\nStory number {i} of the usual layout, which is long." for i in range(200))
    assert all(got[1000 + i] == f"Letter {i} of the seldom layout." for i in range(6))
    # copies of one page don't make its text template
    assert all("Letter 0" in got[2000 + i] for i in range(20))
    # a text that differs on a single page of the host is a slot, whichever page it is
    assert all(got[3000 + i].endswith("known about them" if i == 30 else "known about us") and "Menu two" not in got[3000 + i] for i in range(40))


def test_wrappers_do_not_depend_on_the_deal(spark, monkeypatch):
    rows = rows_of()
    frame = lambda x, n: spark.createDataFrame(x, "page_id long, url string, html string").withColumn("host", wrappers.host()).repartition(n)
    want = {(r.host, r.wrapper) for r in wrappers.wrappers_of(frame(rows, 1)).collect()}
    assert len(want) == 3
    monkeypatch.setattr(wrappers, "HELD", 5)
    random.Random(5).shuffle(rows)
    assert {(r.host, r.wrapper) for r in wrappers.wrappers_of(frame(rows, 7)).collect()} == want
    for host, wrapper in want:
        alone, whole = (wrappers.json.loads(w) for w in (wrappers.inferred([p for _, u, p in rows if u.startswith(f"http://{host}/")]), wrapper))
        assert alone == whole


def test_deep_pages_are_read_with_a_wrapper():
    page = "<html><body>" + "<div class='a b'>" * 30_000 + "deep %d"
    pages = [page % i for i in range(4)]
    wrapper = wrappers.json.loads(wrappers.inferred(pages))
    assert [wrappers.main_text(p, wrapper) for p in pages] == [f"deep {i}" for i in range(4)]
