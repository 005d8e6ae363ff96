"""Every query of the library against the same in SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from sableframe import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = queries.queries(), queries.oracle_sql()


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return str(x)


def compared(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([plain(r[i]) for i in order] for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    found = duck.execute(SQL[name])
    assert compared(df.columns, df.collect()) == compared([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150


@pytest.mark.parametrize("short", [1000, 0])
def test_leaks_across_broken_words(spark, short):
    from sableframe.operators.evaluate import leaks

    passage = "The committee published comprehensive information about foo-bar"
    items = [
        (1, passage), (2, "abcd"), (3, "abc"), (4, passage.upper()), (5, "x" * 24), (6, None), (7, "江苏省南京市，鼓楼区"), (8, "张三 李四"), (9, "Straße—Größe"), (10, "@#$%^"),
        (11, "甲方：信尔胜机械（江苏）有限公司与乙方签订的合同"),
    ]
    docs = [
        (1, "..the committee pub-\nlished compre hensive informa-tion aboutfoobar!"), (2, "xabcdy"), (3, passage[1:]), (4, None), (11, "江苏省南京市 鼓楼区。张三、李\n四"), (12, "straße Größe"),
        (None, f"a {passage} b"), (6, "ab" + "x" * 23), (6, "y" + "x" * 24), (7, "a b c d"), (13, "a@#$%^b"), (14, "甲方:信尔胜 机械(江苏)有限公司\u3000与乙方签\n订的合同"), (15, "江苏省南京鼓楼区"),
    ]
    marks = set("，。、；：？！“”‘’（）【】《》,.;:?!\"'()[]<>-—_·")

    def form(x):
        return "".join(c for c in x or "" if not c.isspace() and c not in marks).upper()

    want = {(d, i) for d, p in docs for i, o in items if len(form(o)) >= 4 and form(o) in form(p)}
    found = leaks(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), short=short).collect()
    assert len(found) == len(want) == 12 and {tuple(r) for r in found} == want


def test_leaks_by_letters_as_in_sql(spark, duck):
    from sableframe.operators.evaluate import leaks
    from sableframe.queries.text import _STRONG

    items = [(1, "sabcdefg"), (2, "aßb"), (3, "Strasse am Ring"), (4, "ﬁnde ŉᾳ"), (5, "STRAẞE"), (6, "inde")]
    docs = [(1, "xßabcdefg"), (2, "aßb ASSB"), (3, "die straße am ring"), (4, "FINDE ʼNᾼ"), (5, "ﬁNDE ŉᾳ"), (6, "straße"), (7, "strasse am ring")]
    found = leaks(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    form = {x: duck.execute(f"SELECT {_STRONG.format(x='$1')}", [x]).fetchone()[0] for _, x in items + docs}
    want = {(d, i) for d, p in docs for i, o in items if len(form[o]) >= 4 and form[o] in form[p]}
    assert len(want) == 5 and {tuple(r) for r in found} == want


def test_capitals_as_in_sql(spark, duck):
    from pyspark.sql import functions as F

    from sableframe.functions.text import capitals

    letters = [chr(i) for i in range(1, 0x1E944) if not 0xD800 <= i < 0xE000 and (chr(i).upper() != chr(i) or len(chr(i).upper()) > 1)]
    found = dict(spark.createDataFrame([(x,) for x in letters], "x string").select("x", capitals(F.col("x"))).collect())
    want = dict(duck.execute("SELECT x, upper(x) FROM (SELECT unnest($1) AS x)", [letters]).fetchall())
    assert {x: found[x] for x in letters if found[x] != want[x]} == {}
