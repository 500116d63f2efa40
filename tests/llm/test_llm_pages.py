"""WARC archives, URL rules and main text."""

import base64
import hashlib
import html as entities
import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquarry.llm import htmltext, urlfilter, warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def archives(folder):
    return sorted(p for p in folder.rglob("part-*"))


def expected_warc(rows):
    last = {}
    for page, _, text in rows:
        key = text or ""
        if page is not None:
            last[key] = max(page, last.get(key, page))
    out = []
    for page, _, text in rows:
        data = (text or "").encode()
        top = last.get(text or "")
        revisit = top is not None and page != top
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_archive_round_trip(spark, tmp_path, small_pages):
    rows = [(r.page_id, r.url, r.html) for r in small_pages.collect()]
    rows += [(1000, None, None), (1001, "http://a/", ""), (1002, "x\r\ny z", "é" * 300_000), (1003, "u", rows[0][2]), (1004, "u", rows[0][2]),
             (1004, "u", rows[0][2]), (None, "n", "alone"), (None, "n", rows[1][2]), (1005, "b", "a\r\n\r\nb\0\n")]
    df = spark.createDataFrame(rows, PAGES).repartition(3).withColumn("refers_to", F.lit(7)).withColumn("_last", F.lit("clash"))
    folder = str(tmp_path / "a")
    warc.write_archives(df, folder)
    found = warc.read_archives(spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == expected_warc(rows)
    assert all(r.problem is None for r in found)
    texts = {r.page_id: r.payload for r in found if r.record_type == "response" and r.page_id is not None}
    assert all(texts[p] == (t or "") for p, _, t in rows if p in texts)
    assert {r.url for r in found if r.page_id == 1002} == {"x%0D%0Ay%20z"}


def test_files_are_plain_archives(spark, tmp_path, small_pages):
    """Another reader of the format: dictionary frame first, one frame for each record."""
    folder = tmp_path / "b"
    warc.write_archives(small_pages, str(folder))
    total = 0
    for path in archives(folder):
        data = path.read_bytes()
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(data[4:8], "little")
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        rest, records = data[8 + size :], []
        while rest:
            if rest[:4] == b"P*M\x18":
                rest = rest[8 + int.from_bytes(rest[4:8], "little") :]
                continue
            one = press.decompressobj()
            records.append(one.decompress(rest))
            rest = one.unused_data
        assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
        total += len(records) - 1
    assert total == small_pages.count()


def test_short_payloads_are_no_revisits(spark, tmp_path):
    rows = [(i, "u", text) for i, text in enumerate(["aa", "aa", "bbbb", "bbbb"])]
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "c"), least_bytes=3)
    assert sorted((r.page_id, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "c")).collect()) == [(0, None), (1, None), (2, 3), (3, None)]
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "d"))
    assert warc.read_archives(spark, str(tmp_path / "d")).count() == 0


def test_damage_is_reported(spark, tmp_path):
    good = warc.record(1, "u", b"payload", None)
    for bad in (good.replace(b"payload", b"PAYLOAD"), good.replace(b"WARC/1.1", b"WARC/9"), good[:-3], good.replace(b"WARC-Date", b"X-Date"),
                re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: 9\r\n\r\nHTTP", good), b"", good + b"x"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    press = zstandard.ZstdCompressor()
    frames = [press.compress(warc.record(i, "u", b"%d" % i, None)) for i in range(3)]
    broken = bytearray(press.compress(good.replace(b"payload", b"paYload")))
    folder = tmp_path / "e"
    folder.mkdir()
    (folder / "one").write_bytes(frames[0] + bytes(broken) + frames[1])
    (folder / "two").write_bytes(frames[2] + frames[0][:-5])
    (folder / "three").write_bytes(frames[2] + b"junk")
    rows = warc.read_archives(spark, str(folder)).collect()
    assert sorted(r.page_id for r in rows if r.problem is None) == [0, 1, 2, 2]
    assert sorted(r.problem for r in rows if r.problem) == ["frame is cut off", "no frame", "wrong block digest"]


def test_frames_of_every_kind():
    draw = random.Random(11)
    for size in (0, 1, 200, 70_000, 300_000):
        for data in (b"a" * size, draw.randbytes(size)):
            for options in ({}, {"write_checksum": True}, {"write_content_size": False}):
                frame = zstandard.ZstdCompressor(**options).compress(data)
                assert warc.frame_end(memoryview(frame + b"rest"), 0) == len(frame)
                with pytest.raises((ValueError, IndexError)):
                    warc.frame_end(memoryview(frame[:-1]), 0)


def expected_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fit, key=lambda r: (-len(r.name), -len(r.host)), default=None)
    return host, path, best and best.name, best.action if best else "allow"


def test_rules(spark):
    draw = random.Random(12)
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "xexample.com", "a.net", "net", "a.b.www.example.com", "ünï.com", "", "com.", "a\0b.com"]
    paths = ["", "/", "/en/", "/en", "/fr/x/com/", "/es/?q", "/EN/", "?x=/en/", "#a", "/é/en/", "//", "/en/" + "x" * 3000]
    urls = [f"{s}://{h}{p}" for h in hosts for p in paths for s in ("http", "a://b")] + [None, "", "no scheme.com/", "://", "x\n://net/fr/"]
    rules = [*urlfilter.RULES, urlfilter.Rule("block", "www.example.com", "/e"), urlfilter.Rule("block", "b.com", "")]
    rules += [urlfilter.Rule("allow", f"h{i}.{draw.choice(['net', 'org'])}", f"/{i}/") for i in range(60)]
    urls += [f"http://s.h{i}.net/{i}/" for i in range(60)]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES).withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    for chosen in (urlfilter.RULES, rules):
        found = urlfilter.judge(df, chosen).orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in found] == [expected_verdict(u, chosen) for u in urls]
    assert urlfilter.judge(df.limit(0)).count() == 0
    assert {(r.rule, r.verdict) for r in urlfilter.judge(df, []).collect()} == {(None, "allow")}


def test_automaton_packs_many_words():
    draw = random.Random(13)
    globs = [re.sub(r"\*+", "*", "".join(draw.choice("ab*") for _ in range(draw.randrange(1, 20)))) for _ in range(40)]
    texts = ["".join(draw.choice("ab\0") for _ in range(draw.randrange(0, 25))).encode() for _ in range(400)]
    found = urlfilter.Automaton(globs).match(texts)
    patterns = [re.compile(g.replace("*", "[^\0]*").encode(), re.S) for g in globs]
    assert found.tolist() == [[bool(p.fullmatch(t)) for p in patterns] for t in texts]


def article(page):
    m = re.search(r"<article>(.*?)(</article>|<footer>|$)", page or "", re.S)
    text = re.sub(r"</?(p|h1)>", "\0", m[1] if m else "")
    text = re.sub(r"<[^>]*(>|$)", "", text.replace("<br>", " "))
    return "\n".join(x for x in (" ".join(entities.unescape(b).split()) for b in text.split("\0")) if x)


def test_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in htmltext.extract_text(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r.page_id].text == article(r.html) and found[r.page_id].n_chars == len(article(r.html)) and found[r.page_id].url == r.url


def test_wrapper_without_declared_article(spark):
    """Plain containers: only what varies between the pages of a host is content."""
    draw = random.Random(14)
    words = lambda n: " ".join(f"w{draw.randrange(5000)}" for _ in range(n))
    rows, expected = [], {}
    for i in range(30):
        parts = [words(12) for _ in range(draw.randrange(2, 6))]
        body = "".join(f"<p>{p}</p>" for p in parts)
        rows.append((i, f"http://one.org/{i}", "<html><body><div class='top'><a href='/'>Home</a> <a>News</a></div><div class='box'><ul><li>First</li>"
                     f"<li>Second</li></ul></div><div class='col'>{body}<div class='tools'>Print this page</div></div><div class='base'>All rights</div></body></html>"))
        expected[i] = "\n".join(parts)
    found = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == expected


def test_declared_articles_are_kept_whole(spark):
    """Near copies with one title do not take the title from an article."""
    draw = random.Random(17)
    words = lambda n: " ".join(f"w{draw.randrange(5000)}" for _ in range(n))
    shared, rows, expected = [words(40) for _ in range(5)], [], {}
    for i in range(100):
        parts = ["One title", "Same item", *shared, words(9)] if i < 97 else [f"Title {i}", f"Item {i}", words(60), words(40)]
        title, item, *rest = parts
        body = f"<h1>{title}</h1><ul><li>{item}</li></ul>" + "".join(f"<p>{p}</p>" for p in rest)
        rows.append((i, f"http://one.org/{i}", f"<html><body><div class='top'>Home</div><article>{body}</article></body></html>"))
        expected[i] = "\n".join(parts)
    found = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == expected


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "http://a/", ""), (3, "http://a/", "plain & simple &lt;text&gt;"), (None, "http://a/", "<p>no id"),
        (4, "http://b/", "<article><h1>T</h1><p>a&nbsp;b\n c<b>d</b><p>e<br>f</p><script>x('<p>')</script><!-- <p>no</p> --></article><p>out"),
        (5, "http://b/", "<main><header><h1>Kept</h1></header><div class='comments'><p>reader</p></div><p>one</p><form>no</form><p hidden>no</p></main>"),
        (6, "http://b/", "<nav>menu</nav><aside>side</aside><p>text <span class='ad'>buy <span>now</span></span>end</p><footer>f"),
        (7, "http://b/", "<article>" + "<p>x</p>" * 20000 + "</article>"), (8, "http://b/", "<" * 2000 + "<p a='" + "\"" * 999),
        (4, "http://b/", "<article><p>again</p></article>"),
    ]
    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("host", F.lit(2))
    found = [(r.page_id, r.text) for r in htmltext.extract_text(df).collect()]
    assert len(found) == len(rows)
    by = {}
    for key, text in found:
        by.setdefault(key, []).append(text)
    assert by[1] == by[2] == [""] and by[3] == ["plain & simple <text>"] and by[None] == ["no id"]
    assert sorted(by[4]) == ["T\na b cd\ne f", "again"]
    assert by[5] == ["Kept\none"]
    assert by[6] == ["text end"]
    assert by[7] == ["\n".join(["x"] * 20000)]
    assert htmltext.extract_text(df.limit(0)).count() == 0


def test_article_content_with_suspicious_names(spark):
    """Names that only resemble those of menus exclude nothing by themselves; repeated parts with such names do go."""
    rows, expected = [], {}
    for i in range(20):
        keep = [f"Title {i}", f"Work {i} like this", f"Body {i} text"]
        rows.append((i, f"http://c.org/{i}", f"<body><article><h1 class='page-header'>{keep[0]}</h1><div class='related-work'><p>{keep[1]}</p></div>"
                     f"<p>{keep[2]}</p><div class='share-links'>Share this</div><div class='ad'>Buy {i}</div></article></body>"))
        expected[i] = "\n".join(keep)
    found = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == expected


def test_declared_tag_is_only_evidence(spark):
    """A declared part that repeats on every page is no article; what varies beside it is."""
    rows = [(i, f"http://d.org/{i}", f"<body><main><p>Welcome to our pages</p></main><div class='col'><p>Long text {i} about {i * i} things</p></div></body>") for i in range(20)]
    rows.append((99, "http://e.org/", "<body><main><p>Alone</p></main><div class='col'><p>beside</p></div></body>"))
    found = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {**{i: f"Long text {i} about {i * i} things" for i in range(20)}, 99: "Alone"}


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "".join(f"<li><p>item {i}</p></li><div>x{i}</div>" for i in range(1500))
    rows = [(1, "http://a/", deep), (2, "http://a/", "<div>" * 2999 + "other"), (3, "http://b/", f"<main>{long}</main>"), (4, "http://b/", f"<main><h2>new</h2>{long}<p>end</p></main>")]
    found = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    items = "\n".join(f"item {i}\nx{i}" for i in range(1500))
    assert found == {1: "deep", 2: "other", 3: items, 4: f"new\n{items}\nend"}


def test_long_lists_are_aligned_as_a_whole():
    """Parts far apart find each other; slots are as long at any depth."""
    draw = random.Random(18)
    posts = [f"<div class='post'><p>{draw.random()}</p></div>" for _ in range(300)]
    other = [f"<div class='post'><p>{draw.random()}</p></div>" for _ in range(300)]
    one = htmltext.parse("".join(posts) + "<section>end</section>")
    two = htmltext.parse("<section>start</section>" + "".join(other[:150]) + posts[0] + "".join(other[150:]) + "<section>end</section>")
    found = {}
    htmltext.match(one, two, found)
    assert len({id(n) for n in found.values()}) == len(found)
    assert found[id(one.children[-1])] is two.children[-1]
    assert sum(id(c) in found for c in one.children) == 301


def brute_match(a, b):
    """Largest order-preserving match, by all splits."""
    if a.label != b.label:
        return 0.0
    if not a.children or not b.children:
        return 2.0 if a.text == b.text else 1.0

    def best(x, y):
        if not x or not y:
            return 0.0
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + brute_match(x[0], y[0]))

    return 1.0 + best(a.children, b.children)


def test_tree_matching_is_largest():
    draw = random.Random(15)

    def page(depth=0):
        return "".join(f"<{t}>{page(depth + 1) if depth < 2 else draw.choice('ab')}</{t}>" for t in draw.choices(["div", "ul", "section"], k=draw.randrange(1, 4)))

    for _ in range(40):
        one, two = htmltext.parse(page()), htmltext.parse(page())
        found = {}
        assert htmltext.match(one, two, found) == brute_match(one, two)
        below = {id(c): p for p in htmltext._order(one) for c in p.children}
        assert all(below[k] is one or found[id(below[k])].children.count(n) for k, n in found.items())


def test_user_columns_with_working_names_survive(spark):
    rows = spark.createDataFrame([(1, "http://a.com/x")], "page_id bigint, url string")
    for name in ("_host", "_path", "_rule", "__host"):
        rows = rows.withColumn(name, F.lit("mine"))
    found = urlfilter.judge(rows).first()
    assert (found["_host"], found["_path"], found["_rule"], found["__host"]) == ("mine",) * 4
    assert (found["host"], found["path"], found["rule"], found["verdict"]) == ("a.com", "/x", "com/", "allow")
    assert urlfilter.judge(rows, rules=()).first()["_rule"] == "mine"
