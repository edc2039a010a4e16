import hashlib
import html
import html.parser
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from noteloom.llm import chat_format, hamming_search, html_extract, pii, sharding, url_filter
from noteloom.llm import sentencepiece_bpe as bpe
from noteloom.llm.queries import ORACLES, block_patterns, tokenizer_path

DOCS = "doc_id long, text string, lang string, shard string, slot int, id string"


def docs(spark, texts):
    """Documents with extra columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, "en", "x", -1, "y") for i, t in texts], DOCS)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- Sharding


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 5, 24, 25, 1000, 4097):
        got = {r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()}
        assert got == set(range(n))


def test_sharding_law(spark):
    texts = [(i if i % 7 else None, f"é{i}" if i % 5 else None) for i in range(500)] + [(3, "same")] * 20 + [(9, "")]
    got = sharding.shard_documents(docs(spark, texts), 24).collect()
    assert len(got) == len(texts)
    for r, n in zip(range(24), [sum(x.shard == s for x in got) for s in range(24)]):
        assert n in (len(texts) // 24, len(texts) // 24 + 1)
        assert sorted(x.slot for x in got if x.shard == r) == list(range(n))
    assert sum(x.size == 8 for x in got) == sum(not t for _, t in texts)
    one = next(x for x in got if x.doc_id == 1)
    assert (one.size, one.text_crc32) == (8 + len("é1".encode()), zlib.crc32("é1".encode()))
    again = sharding.shard_documents(docs(spark, texts).repartition(7), 24)
    assert rows(again, "doc_id", "shard", "slot", "text_crc32") == sorted(((x.doc_id, x.shard, x.slot, x.text_crc32) for x in got), key=repr)
    assert sharding.shard_documents(docs(spark, []), 24).count() == 0


# --- URL filter


def test_url_filter_against_plain_rules(spark):
    r = random.Random(4)
    hosts = ["example.org", "www.example.org", "EXAMPLE.org", "a.com", "com", "notexample.org", "my-casino.net", "ads.example.net", "b.de"]
    paths = ["", "/", "/es/", "/en/1", "/en/12/x", "/EN/1", "/fr/x", "/de/", "/a/ads/b", "/fr?x=/de/", "/pills.html"]
    urls = [r.choice(["http://", "https://", "", "x"]) + r.choice(hosts) + r.choice(paths) + r.choice(["", "?q=1", "#f"]) for _ in range(300)] + [None, "", "://", "http://a\nb.org/"]
    pages = spark.createDataFrame([(i if i % 9 else None, u, "h") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")
    host_rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    patterns = ["^casino^", "^ads^", "^pills^", "*"]
    for some in (patterns[:3], patterns):
        rules = [url_filter.host_path_rule(v, s) for v, s in host_rules] + [url_filter.pattern_rule("block", p) for p in some]
        expect = []
        for i, u in enumerate(urls * 2):
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest[len(host) :].startswith("/") else ""
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
            fit = [(len(s), s, v) for v, s in host_rules for h, p in [s.split("/", 1)] if (low == h or low.endswith("." + h)) and path.startswith("/" + p)]
            best = max(fit, default=None)
            spam = u is not None and ("*" in some or any(re.search(rf"(?:^|[^A-Za-z0-9]){w}(?:[^A-Za-z0-9]|$)", low + path) for w in ("casino", "ads", "pills")))
            expect.append((i if i % 9 else None, low, path, best[1] if best else None, best[2] if best else "block" if spam else "allow"))
        got = url_filter.filter_urls(pages, rules)
        assert rows(got, "page_id", "host", "path", "rule", "verdict") == sorted(expect, key=repr)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_thousands_of_rules_against_each_rule(spark, monkeypatch):
    """The registered patterns by every rule's own expression on every URL, with hot URLs dealt over several tasks."""
    monkeypatch.setattr(url_filter, "ROWS_OF_URL", 40)
    r = random.Random(6)
    words = ["casino", "poker", "ads", "casino7", "poker59", "tracker-x", "spam-farm", "xxx3", "plain", "ads-12.html", "popunder"]
    urls = [f"http://{r.choice(words)}{r.choice(['.', '-'])}{r.choice(words)}.example.net/{r.choice(words)}/{r.choice(words)}{r.choice(['-7', '-59', '/', '.html', '5.html?x=1', ''])}" for _ in range(400)] + [None] * 90 + ["http://casino1.example.net/"] * 90
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(8)
    patterns = block_patterns()
    rules = [url_filter.pattern_rule("block", p) for p in patterns]
    assert len(patterns) > 2500 and all(x.tokens for x in rules)
    one = lambda p: re.compile((r"^(?:[^/]*\.)?" if p[:2] == "||" else "") + "".join({"*": ".*", "^": "(?:^|[^A-Za-z0-9]|$)"}.get(c) or re.escape(c) for c in p.removeprefix("||")), re.S)
    plain = [(p, one(p)) for p in sorted(patterns)]
    found = {u: next((p for p, e in plain if e.search(u.split("://")[1].split("?")[0])), None) for u in set(urls) - {None}}
    got = {x.page_id: x.pattern for x in url_filter.filter_urls(pages, rules).collect()}
    assert got == {i: found.get(u) for i, u in enumerate(urls)} and len({*got.values()}) > 20


def test_rule_tokens():
    assert url_filter.host_path_rule("block", "example.org/en/1").tokens == ("example", "org", "en")
    assert url_filter.pattern_rule("block", "||ads.*/x^").tokens == ("ads", "x")
    assert url_filter.pattern_rule("block", "casino").tokens == ()


# --- Chat formatting

CHAT = "conv_id long, turn long, role string, text string, turns int, rendered string"


def test_chat_snapshots(spark):
    a = [("user", "hi"), ("assistant", "yes"), ("user", "ok"), ("assistant", None)]
    convs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "hi"), ("assistant", "no")], 6: [("user", "")], 7: [("userhi", "")], 8: [(None, None)]}
    data = [(c, t, r, x, 0, "z") for c, turns in convs.items() for t, (r, x) in enumerate(turns)] + [(None, 0, "user", "lost", 0, "z")]
    got = chat_format.format_chats(spark.createDataFrame(data, CHAT).repartition(5))
    assert rows(got, "conv_id", "n_turns", "n_copies") == [(3, 4, 2), (5, 2, 1), (6, 1, 1), (7, 1, 1), (8, 1, 1)]
    text = next(r.rendered for r in got.collect() if r.conv_id == 5)
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nno<|im_end|>\n"
    assert chat_format.format_chats(spark.createDataFrame([], CHAT)).count() == 0
    con = duckdb.connect()
    conversations = spark.createDataFrame(data, CHAT).toPandas().astype({"conv_id": "Int64"})  # noqa: F841
    want = con.execute(ORACLES["op4_chat_format"]).fetchdf()
    assert rows(got, "conv_id", "n_turns", "n_copies", "n_snapshots", "rendered") == sorted((tuple(x) for x in want[["conv_id", "n_turns", "n_copies", "n_snapshots", "rendered"]].itertuples(index=False)), key=repr)
    links = chat_format.snapshot_links(spark.createDataFrame(data, CHAT))
    assert rows(links, "conv_id", "kept_id") == [(1, 3), (2, 3), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7), (8, 8)]


def test_long_and_branching_conversations(spark):
    """Prefix relations by plain comparison, with repeated turn numbers and a conversation of thousands of turns."""
    r = random.Random(3)
    convs = {}
    for c in range(60):
        base = list(convs[r.randrange(c)][: r.randint(1, 9)]) if c and r.random() < 0.7 else []
        convs[c] = base + [("user", r.choice("abc")) for _ in range(r.randint(0 if base else 1, 3))]
    convs[100] = [("user", "x")] * 6000
    convs[101] = [("user", "x")] * 5999
    data = [(c, t, role, text, 0, "z") for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    got = chat_format.format_chats(spark.createDataFrame(data, CHAT))
    extends = lambda a, b: len(a) > len(b) and a[: len(b)] == b
    maximal = {min(k for k, x in convs.items() if x == t): t for t in convs.values() if not any(extends(x, t) for x in convs.values())}
    kept = {c: min(k for k, x in maximal.items() if x == t or extends(x, t)) for c, t in convs.items()}
    want = [(k, len(t), sum(x == t for x in convs.values()), sum(kept[c] == k and x != t for c, x in convs.items())) for k, t in maximal.items()]
    assert rows(got, "conv_id", "n_turns", "n_copies", "n_snapshots") == sorted(want, key=repr)
    assert rows(chat_format.snapshot_links(spark.createDataFrame(data, CHAT)), "conv_id", "kept_id") == sorted(kept.items(), key=repr)


# --- Hamming search


def test_hamming_topk_is_exact(spark):
    r = random.Random(7)
    vectors = [[r.gauss(0, 1) for _ in range(64)] for _ in range(150)]
    data = [(i, vectors[i % 150] if i % 4 else vectors[0], 5) for i in range(400)] + [(None, vectors[3], 0), (500, None, 0), (600, vectors[9], 0), (600, vectors[9], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, distance int")
    got = {}
    for x in hamming_search.search_embeddings(df, 10, 100).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.distance, x.id))
    code = lambda v: sum(1 << i for i, x in enumerate(v) if x > 0)
    for q in (0, 100, 200, 300, 600):
        own = code(next(v for i, v, _ in data if i == q))
        all_ = sorted(((own ^ code(v)).bit_count(), -1 if i is None else i) for i, v, _ in data if v)[:10]
        assert [(d, -1 if i is None else i) for _, d, i in sorted(got[q])] == all_
    few = hamming_search.search_embeddings(df.where("vec_id < 3"), 10, 100)
    assert few.count() == 3 and hamming_search.search_embeddings(df.limit(0), 10, 100).count() == 0


def test_hamming_codes_of_any_width(spark):
    r = random.Random(17)
    vectors = [[r.gauss(0, 1) for _ in range(384)] for _ in range(12)]
    near = lambda v: [x if r.random() < 0.99 else -x for x in v]
    data = [(i, near(vectors[i % 12])) for i in range(240)] + [(701, vectors[0][:65]), (702, []), (703, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    code = lambda v: sum(1 << i for i, x in enumerate(v) if x > 0)
    got = {}
    for x in hamming_search.search_embeddings(df, 5, 100).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.distance, x.id))
    assert set(got) == {0, 100, 200}
    for q, found in got.items():
        own = code(dict(data)[q])
        assert [(d, i) for _, d, i in sorted(found)] == sorted(((own ^ code(v)).bit_count(), i) for i, v in data if v is not None)[:5]


# --- HTML


def test_hamming_rows_that_share_an_id(spark):
    codes = spark.createDataFrame([(5, 1), (5, 2), (None, 4), (None, 8), (9, 0x0007000700070007)], "id long, code long")
    got = hamming_search.nearest(codes, spark.createDataFrame([(0, 0)], "query_id long, code long"), 5).orderBy("rank").collect()
    assert [(x.id, x.distance) for x in got] == [(None, 1), (None, 1), (5, 1), (5, 1), (9, 12)]


def test_html_keeps_containers_of_an_article():
    long, short = ["long words " * 45 + str(i) for i in range(6)], [f"short {i} " * 15 + "." for i in range(3)]
    table = "<table>" + "".join(f"<tr><td>a{i}</td><td>b{i}</td></tr>" for i in range(3)) + "</table>"
    cells = [f"{c}{i}" for i in range(3) for c in "ab"]
    for inner in ("section", "div"):
        body = "".join(f"<p>{x}</p>" for x in long) + f"<{inner}>" + "".join(f"<p>{x}</p>" for x in short) + f"</{inner}>" + table
        want = [" ".join(x.split()) for x in long + short] + cells
        for page in (f"<article>{body}</article>", f"<main>{body}</main>", f"<body><div>x</div><main><article><div>{body}</div></article></main></body>"):
            assert html_extract.main_text(page).split("\n") == want
    teaser = "<main><article>" + "".join(f"<p>{x}</p>" for x in long) + "</article>" + "<p><a href=x>more</a></p>" * 6 + "</main>"
    assert "more" not in html_extract.main_text(teaser)


def test_html_class_names():
    text = "Words of the page " * 20
    want = text.strip()
    for name in ("right-sidebar", "search-results", "has-banner", "no-menu", "sidebar", "notice"):
        for tag in ("html", "body", "main", "article"):
            assert html_extract.main_text(f'<{tag} class="x {name}"><p>{text}</p></{tag}>') == want, (tag, name)
    for name in ("search-results", "has-banner", "sidebar-layout", "menu_page"):
        assert html_extract.main_text(f'<div class="{name}"><p>{text}</p></div>') == want, name
    for name in ("ad", "ad-slot", "right-sidebar", "cookie_notice", "related-posts", "x comments"):
        assert html_extract.main_text(f'<article><p>{text}</p><div class="{name}"><p>{text}</p></div></article>') == want, name


def test_html(spark):
    article = "<html><title>t</title><nav>menu</nav><header>h</header><article><h1>T&amp;t</h1><p>One <b>bold</b>\n two<p>Three<script>x('<p>')</script>!<aside>no</aside><form>f<p>g</form></article><div class='comments'><p>c</div><footer>f</footer>"
    plain = "<body><div id=menu><a href=1>a</a> <a href=2>b</a></div><div><h1>Title</h1><p>A long text with many words that reads on and on for a while.</p><p>Short</p></div><div><a href=1>x</a><a href=2>y</a></div>"
    pages = [(1, "u", article), (2, "v", plain), (3, "w", None), (None, None, ""), (5, "x", "just text &nbsp; here"), (6, "y", "<p>" + "word " * 200_000), (7, "z", "<div>" * 3000 + "deep"), (8, "q", "<article><!-- <p>no</p> --><p>a<br>b&#8364;&eacute;</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract_pages(df).collect()}
    assert got[1].text == "T&t\nOne bold two\nThree!" and got[1].n_chars == len(got[1].text)
    assert got[2].text.startswith("Title\nA long text") and "Short" in got[2].text and "y" not in got[2].text.split("\n")[-1]
    assert got[3].text == "" and got[None].text == "" and got[5].text == "just text here"
    assert got[6].n_chars == 5 * 200_000 - 1 and got[7].text == "deep" and got[8].text == "a b€é"
    assert html_extract.extract_pages(df.limit(0)).count() == 0


class Node:
    def __init__(self, tag, attrs=(), up=None):
        self.tag, self.attrs, self.up, self.inner = tag, dict(attrs), up, []


class Tree(html.parser.HTMLParser):
    """A page as nested nodes; end tags stay as marks among the children, for their number counts."""

    def __init__(self):
        super().__init__()
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.BLOCK and (self.at.tag in html_extract.CLOSES.get(tag, ()) or (self.at.tag == "p" and tag != "p")):
            self.at = self.at.up
        node = Node(tag, attrs, self.at)
        self.at.inner.append(node)
        if tag not in html_extract.VOID and (tag in html_extract.BLOCK or html_extract.standing(tag, attrs) or tag in ("a", "em", "span", "strong")):
            self.at = node

    def handle_endtag(self, tag):
        node, opened = self.at, []
        while node.up and node.tag != tag and (tag in html_extract.BLOCK or node.tag not in html_extract.BLOCK):
            opened.append(node)
            node = node.up
        closes = node.up is not None and node.tag == tag
        self.at.inner.append(("end", tag))
        if closes:
            self.at = node.up

    def handle_data(self, data):
        self.at.inner.append(data)


def plain_main_text(page):
    """The contract of main_text by a walk over nested nodes and plain loops."""
    tree = Tree()
    tree.feed(page)
    tree.close()
    H = html_extract
    own = lambda n: H.standing(n.tag, list(n.attrs.items()))
    lines, state = [], {"tags": 0, "linked": 0, "parts": []}

    def up(n):
        while n:
            yield n
            n = n.up

    def flush():
        seen = []
        for owner, _ in state["parts"]:
            if owner not in seen:
                seen.append(owner)
        for owner in seen:
            text = " ".join("".join(t for o, t in state["parts"] if o is owner).split())
            if text:
                lines.append((text, state["tags"], min(state["linked"], len(text)), owner))
        state.update(tags=0, linked=0, parts=[])

    def owner(n):
        return next(x for x in up(n) if not x.up or x.tag in H.BLOCK or own(x))

    def walk(n):
        for x in n.inner:
            if isinstance(x, str):
                if not any(own(y) == H.NO_TEXT for y in up(n)):
                    state["parts"].append((owner(n), x))
                    state["linked"] += len(x) * any(y.tag == "a" for y in up(n))
            elif isinstance(x, tuple):
                if x[1] in H.BLOCK:
                    flush()
                state["tags"] += 1
            else:
                if x.tag in H.BLOCK:
                    flush()
                elif x.tag == "br":
                    state["parts"].append((owner(n), " "))
                state["tags"] += 1
                walk(x)
                if x.tag in H.BLOCK and x.tag not in H.VOID:
                    flush()

    walk(tree.root)
    flush()

    def holds(n, tags):
        return any(isinstance(x, Node) and (x.tag in tags or holds(x, tags)) for x in n.inner)

    def beside(n):
        return any(own(x) == H.BESIDE_IT or (own(x) == H.NAMED and not (x.tag in ("h1", "main") or holds(x, ("h1", "main")))) for x in up(n))

    n = len(lines)
    mine = [0 if beside(o) else len(t) - k for t, _, k, o in lines]
    value = [math.log(1 + m / max(1, g)) for m, (_, g, _, _) in zip(mine, lines)]
    reach = int(3 * H.SIGMA)
    smooth = []
    for i in range(n):
        near = [(math.exp(-((i - j) ** 2) / (2 * H.SIGMA**2)), value[j]) for j in range(n) if abs(i - j) <= reach]
        smooth.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    free = [i for i in range(n) if not beside(lines[i][3])]
    if not free:
        return ""
    low, high = min(smooth), max(smooth)
    for _ in range(50):
        a, b = [v for v in smooth if v < (low + high) / 2], [v for v in smooth if v >= (low + high) / 2]
        low, high = (sum(a) / len(a) if a else low), sum(b) / len(b)
    cut = (low + high) / 2 if a else min(smooth)
    able = [i for i in free if mine[i] > len(lines[i][0]) / 2] or free
    chosen = [i for i in able if smooth[i] >= cut] or [i for i in able if smooth[i] == max(smooth[j] for j in able)]
    article = lambda i: next((x for x in reversed(list(up(lines[i][3]))) if x.tag == "article"), None)
    total = lambda some: sum(len(lines[i][0]) for i in some)
    inside = [i for i in chosen if article(i)]
    if inside and total(inside) >= 0.2 * total(chosen):
        keep = [i for i in free if article(i) and any(article(i) is article(j) for j in inside)]
    else:
        chains = [list(up(lines[i][3])) for i in chosen]
        root = next(x for x in chains[0] if all(any(x is y for y in c) for c in chains))
        box = lambda i: next((x for x in up(lines[i][3]) if x.tag in H.REGION), tree.root)
        keep = []
        for i in free:
            if any(x is root for x in up(lines[i][3])):
                mates = [j for j in free if box(j) is box(i)]
                if any(j in chosen for j in mates) or sum(lines[j][2] for j in mates) * 2 <= total(mates):
                    keep.append(i)
    return "\n".join(lines[i][0] for i in keep)


def test_html_equals_the_plain_walk():
    r = random.Random(31)
    prose = lambda n: " ".join(r.choice(["long", "words", "a", "of", "text,", "reads&amp;on"]) for _ in range(n))
    classes = ["", "", "", " class=ad", " class='x menu'", " id=sidebar", " class='post-body'", " role=navigation", " hidden", " id='market-share'"]

    def piece(depth):
        kind = r.choice(["p", "p", "p", "links", "a", "table", "div", "section", "article", "ul", "nav", "footer", "h1", "span", "script", "aside", "main", "raw"])
        mark = r.choice(classes)
        if kind in ("div", "section", "article", "aside", "main", "nav", "footer") and depth:
            return f"<{kind}{mark}>" + "".join(piece(depth - 1) for _ in range(r.randint(0, 4))) + r.choice([f"</{kind}>", f"</{kind}>", ""])
        if kind == "links":
            return f"<div{mark}>" + f"<a href=x>{prose(2)}</a> " * r.randint(1, 4) + "</div>"
        if kind == "table":
            return "<table><tr>" + "".join(f"<td{r.choice(classes)}>{prose(2)}" for _ in range(3)) + "</table>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{r.choice(['<a href=y>', ''])}{prose(3)}</a>" for _ in range(3)) + "</ul>"
        if kind == "script":
            return "<script>if (a<b) x('<p>')</script>"
        if kind == "raw":
            return prose(3) + r.choice(["<br>", "</b>", "</div>", "<!-- no -->", "<hr>"])
        return f"<p{mark}>{prose(r.choice([2, 8, 60]))} <b>x</b> <span{r.choice(classes)}>y</span>{r.choice(['</p>', ''])}" if kind in ("p", "span", "h1") else f"<{kind}{mark}>{prose(4)}</{kind}>"

    changed = 0
    for _ in range(1500):
        page = "<body>" + "".join(piece(3) for _ in range(r.randint(0, 7)))
        assert html_extract.main_text(page) == plain_main_text(page), page
        parser = html_extract.Lines()
        parser.feed(page)
        parser.close()
        parser.flush()
        changed += html_extract.main_text(page) != "\n".join(x.text for x in parser.lines)
    assert changed > 800


def test_html_pages_give_their_articles(spark):
    """Every page of the table against the text between its article tags, and what the method leaves out."""
    left_out = 0
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    for p in pages:
        blocks = (re.split("</?(?:p|h1)>", a.replace("<br>", " ")) for a in re.findall("<article>(.*?)</article>", p.html, re.S))
        want = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for some in blocks for b in some]
        assert html_extract.main_text(p.html) == "\n".join(b for b in want if b), p.page_id
        parser = html_extract.Lines()
        parser.feed(p.html)
        parser.close()
        left_out += len(html_extract.content_lines(parser.elements, parser.lines)) < len(parser.lines)
    assert left_out == len(pages)


def test_html_loses_no_article_text():
    text = "Words of a text that reads on and on. " * 9
    want = text.strip()
    for page in (
        f'<body class="home has-sidebar"><p>{text}</p></body>',
        f'<body class="page search-open"><p>{text}</p>',
        f'<article class="post has-comments"><p>{text}</p></article>',
        f'<div class="ad">{text}</div><nav>{text}</nav><article><p>{text}</p></article><footer>{text}</footer>',
        f'<div class="comments-area"><h1>{text}</h1></div>',
        f"<div>{text}</div><div class=comments><article class=comment><p>{text * 4}</p></article></div>",
    ):
        assert html_extract.main_text(page) == want, page
    for extra, lines in (
        ("<table><tr><td>a<td>b</table>", ["a", "b"]),
        ("<section><p>short</p></section>", ["short"]),
        ('<p id="market-share">share</p>', ["share"]),
        ("<p><a href=x>all of it is a link</a></p>", ["all of it is a link"]),
    ):
        for page in (f"<article><p>{text}</p>{extra}<p>{text}</p></article>", f"<main><p>{text}</p>{extra}<p>{text}</p></main>"):
            assert html_extract.main_text(page).split("\n") == [want, *lines, want], page
    assert html_extract.main_text(f"<div><p>{text}</p></div><div>{text}</div><div>short</div>").split("\n") == [want, want, "short"]
    assert html_extract.main_text("<nav>menu</nav><footer>foot</footer>") == "" and html_extract.main_text("<article><p>Von.</p></article>") == "Von."
    assert html_extract.main_text(f"<article><p>{text}</p><p>one <span class=ad>buy</span> two</p><p>{text}</p></article>").split("\n")[1] == "one two"


# --- SentencePiece


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    parts = ["a", "b", "the", "in", " ", "  ", "▁", "é", "世", "🪴", "\n", "\t", "\x00", "0", "12", "th", "er", "aaa", "bbbb", "ing", "                    ", "<s>", "Å", "　", "%%%"]
    texts = [None, "", " ", "a ", " a", "▁", "aaaaa" * 500, "ab" * 999, " " * 777, "the" * 2000] + ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(600)]
    data = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(1, "twice")] * 2
    got = bpe.encode_documents(docs(spark, data), path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expect = [(i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t in data for ids in [sp.encode(t or "")]]
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expect, key=repr)
    assert bpe.encode_documents(docs(spark, []), path).count() == 0


# --- PII

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s, d: 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 9 <= len(d) <= 15),
}


def base_spans(text):
    return {k: found for k, (p, ok) in BASE.items() if (found := [m.span() for m in re.finditer(p, text) if ok(m[0], re.sub("[^0-9]", "", m[0]))])}


def test_pii_base_equals_patterns(spark):
    r = random.Random(2)
    parts = ["1", "2", "45", "255", "256", ".", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "4785380592391139", "x@y.z", "é", "4111 1111 1111 1111", "\n", "%"]
    anchors = pii.automaton()
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 30)))
        assert {k: v for k, v in pii.find_spans(text, anchors).items() if k in pii.BASE} == base_spans(text), text
    data = [(1, "é a.b@c.de and 10.0.0.1 "), (2, None), (3, ""), (None, "+1 (017) 555-7713"), (4, "x" * 200_000 + " 4111111111111111"), (4, "x")]
    got = pii.find_pii(docs(spark, data))
    for r_ in got.collect():
        text = next(t for i, t in data if i == r_.doc_id and (i != 4 or (len(t) > 1) == (r_.n_card > 0))) or ""
        spans = base_spans(text)
        assert r_.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in BASE for a, b in spans.get(k, [])).encode()).hexdigest()
    assert got.count() == 6 and pii.find_pii(docs(spark, [])).count() == 0


def test_pii_added_kinds_and_redaction(spark):
    anchors = pii.automaton()
    text = 'IBAN DE89 3704 0044 0532 0130 00, token = "04dbebab91ab85687d33eeaa", https://u:p4ss@host.example/x, account no. 1234567890 but accounts 1234567890; DE89 3704 0044 0532 0130 01.'
    found = pii.find_spans(text, anchors)
    assert [text[a:b] for a, b in found["iban"]] == ["DE89 3704 0044 0532 0130 00"]
    assert [text[a:b] for a, b in found["secret"]] == ["04dbebab91ab85687d33eeaa"]
    assert [text[a:b] for a, b in found["login_url"]] == ["https://u:p4ss@host.example/x,"[:-1]] or found["login_url"]
    assert [text[a:b] for a, b in found["account"]] == ["1234567890"]
    assert pii.redact_text("mail a@b.co or call", anchors) == "mail [EMAIL] or call" and pii.redact_text("plain", anchors) == "plain"
    got = pii.redact(docs(spark, [(1, "x 10.0.0.1 y"), (2, None), (3, "")]))
    assert rows(got, "doc_id", "text", "id") == [(1, "x [IP] y", "y"), (2, None, "y"), (3, "", "y")]


@pytest.mark.parametrize("name", ["op2_feistel_sharding", "op3_url_filter", "op1_hamming_topk", "op4_chat_format", "op8_decontamination"])
def test_sql_is_registered(name):
    assert ORACLES[name].strip().lower().startswith("with")
