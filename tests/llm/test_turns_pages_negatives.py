"""Conversation repair, main texts and hard negatives against brute force."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridlark.llm import hard_negatives, html_text, turn_repair
from gridlark.llm import queries as Q
from llm.conftest import DATA

# --- conversations -----------------------------------------------------------------------------------------------------
ROWS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute_conversations(rows):
    """Every conversation's row: the cheapest edits by keeping whole audits for every state."""
    said = {}
    for conversation, turn, role, text in rows:
        name, kept = " " if conversation is None else conversation, said.setdefault(conversation, [])
        kind = zlib.crc32(f"{name}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted((brute_repair(c, kept) for c, kept in said.items()), key=repr)


def brute_repair(conversation, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    count, seen, kinds = dict(blank=0, duplicate=0, truncated=0), set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        kinds.append(kind)
        if kind:
            count[kind] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # best[text so far as initials: "", "s", "..u", "..a"] = (cost, audit, messages)
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ())}

    def with_inserts(best):
        best = dict(best)
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                for new in "ua":
                    if (state, new) in follow:
                        way = (cost + 5, audit + "I", (*out, "user:" if new == "u" else "assistant:"))
                        if new not in best or way[:2] < best[new][:2]:
                            best[new] = way
        return best

    for (_, role, text), kind in zip(rows, kinds):
        after = {}
        # inserts and the row's own edit as one step: only complete steps are compared
        chains = [(s, *v) for s, v in best.items()]
        for _ in range(3):
            chains += [
                (n, c + 5, a + "I", (*o, "user:" if n == "u" else "assistant:"))
                for s, c, a, o in list(chains) for n in "ua" if (s, n) in follow
            ]
        for state, cost, audit, out in chains:
            ways = [(state, cost + 2, audit + "D", out)]
            if kind not in ("blank", "duplicate"):
                more = 5 * (kind == "truncated")
                if (state, role[:1]) in follow:
                    ways.append((role[:1], cost + more, audit + "K", (*out, f"{role}:{text}")))
                for new, name in (("u", "user"), ("a", "assistant")):
                    if (state, new) in follow:
                        ways.append((new, cost + 1 + more, audit + "R", (*out, f"{name}:{text}")))
            for new, *way in ways:
                if new not in after or tuple(way[:2]) < after[new][:2]:
                    after[new] = tuple(way)
        best = after
    ends = with_inserts(best)
    cost, audit, out = min(v for s, v in ends.items() if s in ("", "a"))
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (conversation, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)


def talk(seed, conversation, longest=14):
    """A conversation with many faults: odd roles, blanks, repeats, cut-off texts, missing and null turns."""
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", " ", "", "Go on!", "well, ", "Yes. ", "\t\n", "so ", "ok.\n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "agent", "", None]
    return [
        (conversation, None if rng.random() < 0.05 else t * rng.choice([1, 1, 2]), rng.choice(roles), rng.choice([*texts, f"t{t}.", None]))
        for t in range(rng.randrange(longest))
    ]


def by_spark(df):
    return sorted((tuple(r) for r in turn_repair.check(df).collect()), key=repr)


def test_conversations_query(spark):
    rows = pq.read_table(f"{DATA}/conversations.parquet").to_pylist()
    expected = brute_conversations([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows])
    found = Q.QUERIES["op11_hirschberg_repair"](spark, DATA)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected
    assert {k for r in expected for k in r[7]} >= set("DKR") and any(r[1] for r in expected)


def test_conversations_with_many_faults(spark):
    rows = [r for seed in range(300) for r in talk(seed, seed - 3 if seed else None)]
    rows += rows[::7] + [(10_000 + i, i, "user", "x.") for i in range(60)]
    random.Random(1).shuffle(rows)
    expected = brute_conversations(rows)
    assert by_spark(spark.createDataFrame(rows, ROWS)) == expected
    assert any(r[7] == "" and r[8] == EMPTY for r in expected)


@pytest.mark.parametrize("size", [1, 3, 50])
def test_long_conversation_in_blocks(spark, monkeypatch, size):
    """One conversation that fills most of the table, in many partitions and blocks."""
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", size)
    rng = random.Random(size)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", f"c{t}.", f"d{t}", ""])) for t in range(700)]
    rows += [r for seed in range(20) for r in talk(seed, seed + 2)] + [(99, 5, "user", "same.")] * 500
    assert by_spark(spark.createDataFrame(rows, ROWS).repartition(5)) == brute_conversations(rows)


def test_crossings_choose_the_least_audit():
    rng = random.Random(4)
    for _ in range(3000):
        codes = tuple((rng.choice(["s", "u", "a", ""]), rng.random() < 0.3) for _ in range(rng.randrange(12)))
        edits, end = turn_repair.solve_whole(codes)
        roles, cut = [{"s": "s", "u": "u", "a": "a"}.get(c, "x") for c, _ in codes], [c for _, c in codes]
        rows = [(i, r, f"{i}{'' if c else '.'}") for i, (r, c) in enumerate(zip(roles, cut))]
        expected = brute_repair(0, rows)
        audit = "".join(edits) + "I" * turn_repair.closing(end)
        assert audit == expected[7]


def test_no_conversations(spark):
    clash = spark.createDataFrame([], ROWS).withColumn("first", F.lit(1)).withColumn("conversation", F.lit(2))
    assert turn_repair.check(clash).collect() == []
    one = spark.createDataFrame([(5, 1, "user", "Hi")], ROWS)
    for name in ("conversation", "n", "blank", "first", "partition", "block", "copy", "kind", "said", "c", "p", "audit"):
        one = one.withColumn(name, F.lit("clash"))
    assert by_spark(one) == brute_conversations([(5, 1, "user", "Hi")])


def test_very_long_text(spark):
    rows = [(1, 3, "user", "w " * 300_000), (1, 4, "assistant", "x" * 500_000 + ".")]
    assert by_spark(spark.createDataFrame(rows, ROWS)) == brute_conversations(rows)


# --- pages ---------------------------------------------------------------------------------------------------------------
def article_by_pattern(page):
    """The supplied pages mark their article; patterns alone can read them."""
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    return " ".join(html.unescape(re.sub("<[^>]*>", "\n", re.sub(r"</?b>", "", body))).split())


def test_pages_query(spark):
    pages = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    expected = {(p["page_id"], p["url"], t := article_by_pattern(p["html"]), len(t)) for p in pages}
    assert {tuple(r) for r in Q.QUERIES["op12_tree_scoring"](spark, DATA).collect()} == expected


SITE = "<div class='menu'><ul><li><a href=1>Home page of the site</a><li><a href=2>All the news, sport, and more</a></ul></div>"
BANNER = "<div id=cookie-notice><p>We use cookies, here, there, and everywhere, as all do, and we like them, we do.</p></div>"
SIDE = "<div id='sidebar'><h3>Popular</h3><p>Something else, quite long, with commas, commas, commas, and more, and so on.</p></div>"
SAID = "<section id=comments><article class=comment><p>I, for one, think, that, all this, is, well, wrong, sorry, bye.</p></article></section>"
FORM = "<form><label>Mail, please, and your name</label><input value=x><textarea>text, text, text</textarea></form>"
LINKS = "<div><a href=1>More about this, that, and other things</a> <a href=2>Another story, of another day, in another place</a></div>"
STORY = [
    "The first paragraph of the story, which is long enough, tells how it began.", "Short.",
    "A second one, with a link in it, goes on about the same matter, and ends here.",
    "The last one says, as they all do, that nobody knows what comes next, or why.",
]
PARAGRAPHS = "".join(f"<p>{p}" for p in STORY).replace("a link", "<a href=z>a link</a>")


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{SITE}{BANNER}<article><h1>A title</h1>{PARAGRAPHS}</article>{SIDE}{SAID}<footer>c, d, e</footer>",
        f"<html><body class='with-sidebar'>{BANNER}{SITE}<main><h1>A title</h1><div>{PARAGRAPHS}</div>{FORM}</main>{SAID}",
        f"{SITE}<div id=wrap>{SIDE}<div class='content'><h1>A title</h1>{PARAGRAPHS}</div>{LINKS}</div><div class='footer'>x</div>",
        f"<div class=post><div class=post-header><h1>A title</h1></div><div class=post-body>{PARAGRAPHS}</div>{FORM}{SAID}</div>{SITE}",
        f"<header><p>The site, since 1900, your source, of words</p></header><h1>A title</h1>{PARAGRAPHS}</p>{SITE}{BANNER}",
        f"<main><section><h1>A title</h1><p>{STORY[0]}</p><p>{STORY[1]}</p></section><section><p>{STORY[2]}</p><p>{STORY[3]}</p>"
        f"</section><aside>{STORY[0]}</aside></main>{SAID}",
        f"<article><header><h1>A title</h1></header>{PARAGRAPHS}<nav>a, b, c</nav><footer>Tags, dates</footer></article>{SIDE}",
        "<div><h1>A title</h1><div>" + "<br>\n".join(STORY) + f"</div></div>{LINKS}",
        f"<article hidden><p>{STORY[0]} {STORY[0]}</p></article><div class=text><h2>A title</h2>{PARAGRAPHS}</div>",
    ],
)
def test_article_of_other_pages(page):
    assert html_text.main_text(page) == " ".join(["A title", *STORY])


def test_markup():
    cases = {
        "a<!-->b": "ab", "a<!-- <p>x --!>b": "ab", '<p title="a>b">c</p>': "c", "x</>y<?php z ?>": "xy", "5 < 6 & 7": "5 < 6 & 7",
        "<script>if(a<b)'</p>'</SCRIPT >x": "x", "x<script>y": "x", "x<!-- y": "x", "x<a href='y>z": "x", "a<br/>b</br>c": "a b c",
        "<p>one <b>two<p>three</i> fo<i>ur</i>": "one two three four", "&lt;p&gt; &amp;amp; &nbsp; &#233;&#55296;": "<p> &amp; é�",
        "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "a b c d", "<table><tr><td>a<td>b<tr><td>c</table>d": "a b c d", "": "",
        "<nav>menu</nav>": "", "<article><p>Hi</article>": "Hi", "\n \t": "", "plain": "plain",
    }
    assert {page: html_text.main_text(page) for page in cases} == cases


def test_awkward_pages(spark):
    long = "<article><p>" + "long, text " * 200_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a"), (None, "u", "<p>a"), (4, "u", long), (5, "", "<div>" * 50_000 + "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract(df.withColumn("text", F.lit("clash")).withColumn("html_", F.lit("clash")))
    found = [(r["page_id"], r["text"]) for r in got.collect()]
    assert sorted(found, key=repr) == sorted([(1, ""), (2, ""), (None, "a"), (None, "a"), (4, ("long, text " * 200_000).strip()), (5, "x")], key=repr)
    assert {r["html_"] for r in got.collect()} == {"clash"}
    assert html_text.extract(df.limit(0)).collect() == []
    assert [r["html"] for r in html_text.extract(df.where("page_id = 2"), output="html").collect()] == [""]


# --- hard negatives ------------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, label int, embedding array<double>"


def brute_negatives(rows, every, positives=5, negatives=10):
    """Full scores of all pairs, from exact integers."""
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    one = {}
    for ident, label, vector in rows:
        if ident is not None and label is not None and fine(vector):
            codes = [int(np.floor(256 * float(x))) for x in vector]
            one[ident] = min(one.get(ident, (label, codes)), (label, codes))
    out = []
    for a, (label, codes) in one.items():
        if a % every:
            continue
        scores = {i: sum(x * y for x, y in zip(codes, c)) for i, (_, c) in one.items() if len(c) == len(codes)}
        order = sorted((i for i in scores if i != a), key=lambda i: (-scores[i], i))
        for p in [i for i in order if one[i][0] == label][:positives]:
            inside = [i for i in order if one[i][0] != label and 30 * scores[p] <= 100 * scores[i] <= 90 * scores[p]]
            out += [(a, p, rank, n, scores[p], scores[n]) for rank, n in enumerate(inside[:negatives], 1)]
    return sorted(out)


def test_negatives_query(spark):
    rows = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in rows]
    expected = brute_negatives(rows, 100)
    got = sorted(tuple(r) for r in Q.QUERIES["op13_vertical_scan"](spark, DATA).collect())
    assert got == expected and len({r[1] for r in got}) > 5


@pytest.mark.parametrize("chunk,shelf,group", [(8192, 1 << 17, 1 << 16), (7, 20, 3)])
def test_negatives_of_clusters_ties_and_bad_rows(spark, monkeypatch, chunk, shelf, group):
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    centres = rng.normal(size=(6, 12))
    points = centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 12)) * 0.3
    rows = [(i, int(rng.integers(0, 4)), (p / np.linalg.norm(p)).tolist()) for i, p in enumerate(points)]
    rows += [(1000 + i, i % 3, rows[8][2]) for i in range(60)]  # a group of equal vectors
    rows += [(2000 + i, i % 2, [0.0] * 12) for i in range(20)] + [(3000 + i, i % 2, [0.5, -0.5]) for i in range(20)]
    rows += [(4000, 1, []), (4004, 0, []), (None, 1, rows[0][2]), (4008, None, rows[0][2]), (4012, 1, None), (4016, 1, [None] * 12)]
    rows += [(4020, 1, [float("nan")] * 12), (4024, 1, [float("inf")] * 12), rows[4], rows[4], (4, 3, rows[5][2])]
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("id", "codes", "shelf", "anchor_group", "score", "rank", "positives"):
        df = df.withColumn(name, F.lit("clash"))
    got = hard_negatives.mine(df, F.col("vec_id") % 4 == 0, shelf=shelf, group=group)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 4)


def test_scan_drops_candidates_early():
    """Clustered rows leave the bitmap before all of their dimensions are read."""
    rng = np.random.default_rng(1)
    matrix = np.concatenate([rng.integers(100, 120, (500, 64)), rng.integers(-120, -100, (500, 64))])
    shelf = hard_negatives.Shelf(np.arange(1000), np.zeros(1000, np.int64), matrix)
    seen = []

    def possible(lower, upper):
        seen.append(len(lower))
        return upper >= np.sort(lower)[-5]

    rows, scores = shelf.scan(matrix[0], 0, np.arange(1000), possible)
    assert seen[0] == 1000 and max(seen[4:]) <= 500
    assert set(scores) <= set(matrix[shelf.ids[rows]] @ matrix[0])


def test_no_vectors(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).collect() == []
