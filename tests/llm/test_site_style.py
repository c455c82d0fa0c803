"""Site style trees on a small site."""

import collections
import math
import random

import pytest

from gleaner.llm import site_style

FRAME = '<html><head><title>x</title></head><body><div class="nav"><ul><li><a href="/">Home</a></li><li>About</li></ul></div><div id="main"><h1>{0}</h1><p>{1}</p></div><div class="foot"><p>All rights reserved</p></div></body></html>'


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, noise string")


def test_common_branches_go_and_content_stays(spark):
    rows = [(i, f"http://Site.example/p{i}", FRAME.format(f"Title {i}", f"story number {i} " * 5)) for i in range(12)]
    rows += [(100, "http://alone.example/", FRAME.format("Only", "page"))]
    got = {r.page_id: r for r in site_style.extract(pages(spark, rows)).collect()}
    for i in range(12):
        assert got[i].text.split("\n")[-2:] == [f"Title {i}", " ".join([f"story number {i}"] * 5)] and got[i].host == "site.example"
        assert "reserved" not in got[i].text and "About" not in got[i].text and got[i].removed >= 3
    assert "reserved" in got[100].text and got[100].removed == 0


def test_awkward(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [(1, "http://a.b/", None), (2, "http://a.b/", ""), (3, None, "<p>no host"), (None, "http://a.b/", "<p>one<p>two"), (4, "nonsense", "a < b </x> <p"), (5, "http://c.d/", deep), (6, "http://c.d/", "<script>var x = '<p>'</script><!-- no"), (7, "http://e.f/", "<p>same</p>"), (7, "http://e.f/", "<p>same</p>")]
    got = [(r.page_id, r.text) for r in site_style.extract(pages(spark, rows)).collect()]
    assert len(got) == len(rows)
    found = dict(got)
    assert found[1] == found[2] == "" and found[3] == "no host" and found[6] == "" and found[4].startswith("a < b")
    assert found[7] == "same"  # a host's only page keeps its text, captured twice or not
    assert site_style.extract(pages(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("hosts", [(1, 2), (3, 2), (5, 3), (12, 10)])
def test_copies_of_pages_keep_their_content(spark, hosts):
    n, copies = hosts
    rows = [(i * 100 + c, "http://site.example/p", FRAME.format(f"Title {i}", f"story number {i}")) for i in range(n) for c in range(copies)]
    got = site_style.extract(pages(spark, rows)).collect()
    assert len(got) == n * copies
    for r in got:
        i = r.page_id // 100
        assert r.text.split("\n")[-2:] == [f"Title {i}", f"story number {i}"] if n > 1 else "story number 0" in r.text
        assert ("reserved" in r.text) == (n == 1)
    assert site_style.extract(pages(spark, rows).limit(0)).count() == 0


def test_one_copy_on_a_small_host(spark):
    def texts(numbers):
        got = site_style.extract(pages(spark, [(k, "http://s.example/", FRAME.format(f"Title {i}", f"story {i}")) for k, i in enumerate(numbers)]))
        return [r.text.split("\n") for r in sorted(got.collect(), key=lambda r: r.page_id)]

    for numbers in ([0, 0, 1], [0, 0, 1, 1, 2]):
        assert texts(numbers) == [[f"Title {i}", f"story {i}"] for i in numbers]


def test_shared_text_on_a_small_host_takes_no_unlike_text_along(spark):
    page = '<body><div class="nav"><p>Home</p></div><div id="main"><h1>{0}</h1><p>{1}</p><p>{2}</p></div></body>'
    two = [(i, "http://two.example/", page.format(f"Title {i}", f"story {i}", "See you soon")) for i in range(2)]
    three = [(10 + i, "http://three.example/", page.format("Same" if i else "Other", f"story {i}", f"end {i}")) for i in range(3)]
    got = {r.page_id: r.text.split("\n") for r in site_style.extract(pages(spark, two + three)).collect()}
    for i in range(2):
        assert got[i] == [f"Title {i}", f"story {i}", "See you soon"]  # 0.667 for the paragraphs
    for i in range(3):
        assert got[10 + i] == ["Same" if i else "Other", f"story {i}", f"end {i}"]  # 0.685 for the titles


def brute(site, threshold=site_style.THRESHOLD):
    """The texts of a host's pages by the definition: a tree of named paths, recursion, every page kept whole."""
    parsed = {html: site_style.parse(html) for html in site}
    names, pages, styles, runs = {}, collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for nodes in parsed.values():
        seen, kids = set(), collections.defaultdict(list)
        for path, _, parent, run in nodes:
            seen.add(path)
            if parent >= 0 and kids[parent][-1:] != [path]:
                kids[parent].append(path)
        pages.update(seen)
        for path, lists in {(nodes[i][0], tuple(k)) for i, k in kids.items()}:
            styles[path][lists] += 1
        for path, run in {(n[0], n[3]) for n in nodes if n[3] is not None}:
            runs[path][run] += 1

    def value(path):
        m = pages[path]
        if path in runs:
            mean = sum(map(math.log, runs[path].values())) / len(runs[path])
            few = mean < math.log(2) - 1e-9 or (m > 2 and mean < math.log(2) + 1e-9)
            return 1.0 if m == 1 or few else 1 - mean / math.log(m)
        total = sum(styles[path].values())
        own = 1.0 if m == 1 else -sum(n / total * math.log(n / total) for n in styles[path].values()) / math.log(m)
        under = sum(n / total * sum(map(value, k)) / len(k) for k, n in styles[path].items())
        weight = 0.9 ** len(styles[path])
        return (1 - weight) * own + weight * under

    def best(path):
        below = {c for k in styles[path] for c in k}
        own = value(path) if path in runs or pages[path] > 1 or not below else 0.0
        return max([own, *map(best, below)])

    out = []
    for html in site:
        cut, kept = set(), []
        for i, (path, _, parent, run) in enumerate(parsed[html]):
            if parent in cut or best(path) < threshold:
                cut.add(i)
            elif run is not None:
                kept.append(run)
        out.append("\n".join(kept))
    return out


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for host, size in (("a.example", 30), ("b.example", 8), ("c.example", 2), ("d.example", 1), ("e.example", 18)):
        site = []
        for i in range(size):
            story = "".join(f"<p>{host} story {i} {j}</p>" for j in range(rng.randint(1, 3)))
            side = rng.choice(["<div class=side><p>Same box</p></div>", "<ul><li>One<li>Two</ul>", ""])
            site.append(rng.choice([f"<body><nav><p>Home</p></nav><div id=m><h1>T{i % 9}</h1>{story}</div>{side}<footer>Foot {i % 2}</footer>", f"<body><div id=m>{story}</div>{side}</body>"]))
        site += site[: rng.randint(0, 2)]
        rows += [(len(rows) + k, f"http://{host}/{k}", html) for k, html in enumerate(site)]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.text for r in site_style.query(spark, str(tmp_path)).collect()}
    want = {}
    for host in {u.split("/")[2] for _, u, _ in rows}:
        own = [(i, h) for i, u, h in rows if u.split("/")[2] == host]
        want |= dict(zip([i for i, _ in own], brute([h for _, h in own])))
    assert got == want
    assert any("Home" not in t for t in got.values()) and all("story" in t for t in got.values())


def test_long_pages(spark):
    long = "<body>" + "".join(f"<div class=c{i % 7}><p>part {i}</p></div>" for i in range(30_000))
    got = site_style.extract(pages(spark, [(1, "http://l.example/", long), (2, "http://l.example/2", "<body><p>short")])).collect()
    assert {r.page_id: r.runs for r in got} == {1: 30_000, 2: 1}
