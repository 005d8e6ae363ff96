"""Values in blocks, tables as grids and replacement over runs, on small cases and against plain versions."""

from __future__ import annotations

import difflib
import html as entities
import random
from collections import Counter

from sableframe.operators import blocks as b
from sableframe.operators import catalog as c
from sableframe.operators import runs as r
from sableframe.operators import tables as t

BLOCKS = [
    "签字 刘中", "琦", "帐号：0383 2700 0400 3104 0 end", "性别：男", "男科 aXa aa aaa", "起至2076年", "4月8日止", "共 ￥1,431,400.00元", "面积100亩", "one two",
    " mid dle", "three x", "<table><tr><td>aa</td></tr></table>", "ACME Compeny Ltd", "a\\Eb (c) [d]", None, "",
]


def test_places_of_values(spark):
    blocks = spark.createDataFrame([(1, k, x) for k, x in enumerate(BLOCKS)], "doc_id long, pos int, text string")
    values = [
        ("PERSON", "刘中\n琦"), ("NO", "03832700040031040"), ("GENDER", "男"), ("T", "aa"), ("DATE", "2076年4月8日"), ("AMOUNT", "1431400，00"), ("AMOUNT", "100元"),
        ("X", "two\nmiddle\nthree"), ("ORG", "ACME Company Ltd"), ("Z", " "), ("AMOUNT", "abc"), ("Q", "a\\Eb (c)"), ("ADDRESS", None), ("N", "$nowhere$"),
    ]
    df = spark.createDataFrame([(1, *v) for v in values] + [(2, "T", "aa")], "doc_id long, type string, value string")
    found = {(x["value"], x["how"], x["pos"], x["start"], x["end"], x["text"]) for x in b.located(df, blocks).collect()}
    assert found == {
        ("刘中\n琦", "wrapped", 0, 3, 5, "刘中"), ("刘中\n琦", "wrapped", 1, 0, 1, "琦"), ("03832700040031040", "spaced", 2, 3, 24, "0383 2700 0400 3104 0"), ("男", "exact", 3, 3, 4, "男"),
        ("aa", "exact", 4, 7, 9, "aa"), ("aa", "exact", 4, 10, 12, "aa"), ("2076年4月8日", "cut", 5, 2, 7, "2076年"), ("2076年4月8日", "cut", 6, 0, 4, "4月8日"),
        ("1431400，00", "amount", 7, 0, 16, "共 ￥1,431,400.00元"), ("two\nmiddle\nthree", "wrapped", 9, 4, 7, "two"), ("two\nmiddle\nthree", "wrapped", 10, 0, 6, "middle"),
        ("two\nmiddle\nthree", "wrapped", 11, 0, 5, "three"), ("ACME Company Ltd", "fuzzy", 13, 0, 16, "ACME Compeny Ltd"), ("a\\Eb (c)", "exact", 14, 0, 8, "a\\Eb (c)"),
    }
    assert difflib.SequenceMatcher(None, "ACME Company Ltd", "ACME Compeny Ltd").ratio() > b.FUZZY_RATIO
    assert b.located(df.limit(0), blocks).count() == 0 and b.located(df, blocks.limit(0)).count() == 0


def filled(rows):
    """A plain grid fill with a set of taken cells."""
    taken, out = set(), []
    for i, row in enumerate(rows):
        col = 0
        for text, w, h in row:
            while (i, col) in taken:
                col += 1
            out.append((text, i, col, h, w))
            taken |= {(y, x) for y in range(i, i + h) for x in range(col, col + w)}
            col += w
    return out


def test_tables_equal_a_plain_grid(spark):
    rng = random.Random(4)
    pages, want = [], []
    for page in range(40):
        rows = [[(f"é {rng.randrange(99)} & <b>", rng.choice((1, 1, 2, 3)), rng.choice((1, 1, 2, 4))) for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(1, 8))]
        markup = "".join("<tr>" + "".join(f"<{'td' if w % 2 else 'TH'} colspan='{w}' ROWSPAN={h} id=x>\n{entities.escape(x)}<i></i> </td>" for x, w, h in row) + "</tr>" for row in rows)
        pages.append((page, f"<p>x<!-- <table><tr><td>no</td></tr></table> --></p><TABLE class=a>{markup}</TABLE>".replace("<!-- <table>", "<!-- "), "k"))
        want += [(page, 0, *cell) for cell in filled(rows)]
    df = spark.createDataFrame([*pages, (98, None, "k"), (99, "<table><tr><td>a<td>b</td></tr><tr></tr><tr><td>open</table>", "k")], "page_id long, html string, row_name string")
    found = t.table_cells(df).collect()
    assert sorted((x["page_id"], x["table_no"], x["text"], x["row"], x["col"], x["row_span"], x["col_span"]) for x in found if x["page_id"] < 99) == sorted(want)
    assert [(x["text"], x["row"], x["col"]) for x in found if x["page_id"] == 99] == [("b", 0, 0)]


def test_tables_among_blocks(spark):
    rows = [
        (1, 0, "<table><tr><td rowspan=2>a</td><td>&amp;lt;b</td></tr><tr><td>c</td></tr><tr><td> </td></tr></table>", 10.0, 0.0, 100.0, 60.0, 0.9),
        (1, 1, "plain", 0.0, 0.0, 1.0, 1.0, 0.5), (1, 2, "<table>no &amp; <b>cells</b></table>", 0.0, 0.0, 1.0, 1.0, 0.5), (1, 3, None, 0.0, 0.0, 1.0, 1.0, 0.5),
    ]
    df = spark.createDataFrame(rows, "doc_id int, pos int, text string, left double, top double, width double, height double, confidence double")
    found = sorted(tuple(x) for x in t.expanded(df).collect() if x["text"])
    assert [x[:7] + x[8:] for x in found] == [
        (1, 0, "<b", 60.0, 0.0, 50.0, 20.0, 1), (1, 0, "a", 10.0, 0.0, 50.0, 40.0, 0), (1, 0, "c", 60.0, 20.0, 50.0, 20.0, 2), (1, 1, "plain", 0.0, 0.0, 1.0, 1.0, None), (1, 2, "no & cells", 0.0, 0.0, 1.0, 1.0, None),
    ]
    assert {round(x[7], 2) for x in found} == {0.81, 0.5}


def plain_runs(runs, names):
    whole = "".join(runs)
    owner = [k for k, x in enumerate(runs) for _ in x]
    found = []
    for old, new in names.items():
        at = whole.find(old)
        while old and at >= 0:
            found.append((at, -len(old), at + len(old), new))
            at = whole.find(old, at + len(old))
    out, last, i = [""] * len(runs), 0, 0
    kept = {}
    for s, _, e, new in sorted(found):
        if s >= last:
            kept[s], last = (e, new), e
    while i < len(whole):
        if i in kept:
            e, new = kept[i]
            out[Counter(owner[i:e]).most_common(1)[0][0]] += new
            i = e
        else:
            out[owner[i]] += whole[i]
            i += 1
    return out


def test_runs_equal_a_plain_version(spark):
    rng = random.Random(8)
    docs, names = [], {}
    for d in range(60):
        docs.append([("".join(rng.choice("abcé漢 ") for _ in range(rng.randrange(0, 7)))) for _ in range(rng.randrange(1, 12))])
        names[d] = {"".join(rng.choice("abc漢") for _ in range(rng.randrange(1, 4))): rng.choice(("", "X", "<long>")) for _ in range(3)}
    runs = spark.createDataFrame([(d, k * 10, x) for d, own in enumerate(docs) for k, x in enumerate(own)] + [(99, 0, None)], "doc_id long, run int, text string")
    mapping = spark.createDataFrame([(d, o, n) for d, own in names.items() for o, n in own.items()] + [(0, "", "Y"), (1, None, "Y")], "doc_id long, original string, replacement string")
    found = {(x["doc_id"], x["run"]): x["text"] for x in r.replaced_runs(runs, mapping).collect()}
    assert found == {(d, k * 10): x for d, own in enumerate(docs) for k, x in enumerate(plain_runs(own, names[d]))} | {(99, 0): ""}
    whole = spark.createDataFrame([(d, "".join(own)) for d, own in enumerate(docs)], "doc_id long, text string")
    parts = {}
    for x in sorted(r.segments(whole, mapping).collect()):
        parts.setdefault(x["doc_id"], []).append(x)
    for d, own in enumerate(docs):
        mine = parts.get(d, [])
        assert "".join(x["text"] for x in mine) == "".join(own)
        assert "".join(x["replacement"] if x["replaced"] else x["text"] for x in mine) == "".join(plain_runs(["".join(own)], names[d]))


def test_batch_selection_of_tied_positions(spark):
    asked = spark.createDataFrame([(1, 7), (1, 5), (2, 6), (0, 9), (3, 5), (4, 8)], "position int, file_id int")
    files = spark.createDataFrame([(5, "a", None, True), (6, "a", None, True), (7, "a", None, True), (8, None, None, True)], "file_id int, name string, deleted_at string, has_output boolean")
    found = {x["file_id"]: (x["archive_name"], x["reason"]) for x in c.batch_selection(asked, files).collect()}
    assert found == {5: ("a", None), 7: ("1_a", None), 6: ("2_a", None), 9: (None, "not_found"), 8: ("file", None)}
