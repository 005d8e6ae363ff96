"""Rules for names of organisations: which keep their name, what stands for the others, and which short names mean a longer one.

All rules are expressions over a trimmed name. Lists of endings become one
pattern each, so a name is read once for a list, whatever its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import trimmed

# Endings and words of the rules below, and what stands for a body of a kind.
PUBLIC_ENDINGS = ("律师事务中心", "法律援助中心", "政务服务中心", "公证处")
PUBLIC_WORDS = ("国务院", "最高人民法院", "最高人民检察院", "中共中央")
INTERNATIONAL_WORDS = ("联合国", "欧盟", "欧洲联盟", "东盟", "北约", "非盟", "阿盟", "世贸组织", "世界贸易组织", "WTO", "世界银行", "国际货币基金", "亚太经合", "红十字", "奥委会")
MINISTRIES = ("司法", "公安", "国家安全", "外交", "国防", "教育", "科技", "工业和信息化", "民政", "财政", "人力资源", "自然资源", "生态环境", "住房", "交通", "水利", "农业", "商务", "文化", "卫生", "退役", "应急", "审计")
BUSINESS_WORDS = ("公司", "企业", "集团", "事务所", "银行", "贸易")
PUBLICATION_ENDINGS = ("杂志", "期刊", "文摘", "日报", "周报", "周刊", "晚报", "早报", "时报", "年鉴", "概况", "指南", "汇编", "公报", "网", "传媒", "电视台", "广播电台", "电台")
ORGANS = {
    "国资委": "某国资委", "司法厅": "某司法厅", "公安厅": "某公安厅", "财政厅": "某财政厅", "教育厅": "某教育厅", "审计厅": "某审计厅", "农业农村厅": "某农业农村厅", "商务厅": "某商务厅",
    "组织部": "某组织部", "宣传部": "某宣传部", "统战部": "某统战部", "政法委": "某政法委", "党委": "某党委", "党组": "某党组",
}
HALLS_ELSE = ("咖啡", "餐", "大厅", "歌厅", "舞厅", "茶厅", "澡堂", "浴室", "游戏")
SERVICE_ENDINGS = (
    "人才库", "专家库", "智库", "管委会", "办公室", "协会", "学会", "联合会", "基金会", "促进会", "研究会", "研究院", "研究所",
    "交流中心", "服务中心", "信息中心", "研究中心", "交易中心", "评审中心", "培训中心", "指导中心",
)
NO_REGION = ("都市", "城市", "商城", "超市", "省城")
REGION = "^[一-龥]{1,6}?(?:省|自治区|市|县|区|旗|盟|州)"
POOLS = {"律师事务所": "LAW_FIRM", "医院": "HOSPITAL", "卫生院": "HOSPITAL", "大学": "SCHOOL", "学院": "SCHOOL", "学校": "SCHOOL", "中学": "SCHOOL", "小学": "SCHOOL"}
ALIAS_LEAST, ALIAS_SHARE = 4, 0.9
#: Bits for the letters of a name, names looked over at once; names of a document for each task that takes a share of its aliases, and most of such tasks.
MASK, BLOCK, SHARE_NAMES, MOST_SHARES = 128, 256, 30_000, 16
ALIAS_EDGES = " ，。；;、()（）[]【】"


def _ends(x: Column, endings: tuple[str, ...], tail: str = "") -> Column:
    return x.rlike(f"(?:{'|'.join(map(re.escape, endings))}){tail}$")


def _has(x: Column, words: tuple[str, ...]) -> Column:
    return x.rlike("|".join(map(re.escape, words)))


def _first_ending(x: Column, values: dict[str, str]) -> Column:
    """The value of the first ending, in order, that fits."""
    out = F.lit(None).cast("string")
    for ending, value in reversed(values.items()):
        out = F.when(x.endswith(ending), value).otherwise(out)
    return out


def public_institution(name: Column) -> Column:
    """Whether a body of state or an international one keeps its name; departments in the name of a business don't."""
    x = F.regexp_replace(trimmed(name), "^中华人民共和国", "")
    business = x.rlike("[部厅]$") & _has(x, BUSINESS_WORDS)
    return ~business & (_ends(x, PUBLIC_ENDINGS) | _has(x, PUBLIC_WORDS + INTERNATIONAL_WORDS) | _ends(x, MINISTRIES, "部"))


def publication(name: Column) -> Column:
    """Whether a name is that of something published: in title marks, or by its ending."""
    x = trimmed(name)
    return x.rlike("^《[^》]{1,40}》$") | _ends(x, PUBLICATION_ENDINGS)


def preserved(name: Column) -> Column:
    return public_institution(name) | publication(name)


def organ_base(name: Column) -> Column:
    """What stands for a local organ of state, by kind; null for all else."""
    x = trimmed(name)
    return F.coalesce(_first_ending(x, ORGANS), F.when(x.endswith("厅") & ~_has(x, HALLS_ELSE), "某厅"))


def service_base(name: Column) -> Column:
    """What stands for a public service: its name without region or nation; null for all else."""
    x = trimmed(name)
    regional = x.rlike(REGION) & ~x.rlike(f"^(?:{'|'.join(NO_REGION)})")
    rest = F.btrim(F.regexp_replace(F.when(regional, F.regexp_replace(x, REGION, "")).otherwise(x), "^(?:中国|全国)", ""))
    tail = _first_ending(x, {e: e for e in SERVICE_ENDINGS})
    return F.when(tail.isNotNull(), F.concat(F.lit("某"), F.when(rest != "", rest).otherwise(tail)))


def pool(name: Column) -> Column:
    """The word pool for a name by its ending; null if none fits."""
    return _first_ending(trimmed(name), POOLS)


def ruled(names: DataFrame, name: str = "text") -> DataFrame:
    """Adds preserved, base (organ first, then service) and pool."""
    x = F.col(name)
    return names.withColumns({"preserved": preserved(x), "base": F.coalesce(organ_base(x), service_base(x)), "pool": pool(x)})


def compact_name(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", ""), F.lit(ALIAS_EDGES))


def _within(short: str, long: str, spare: int) -> bool:
    """Whether all letters of the first string but `spare` occur in order in the second."""
    at = 0
    for c in short:
        i = long.find(c, at)
        if i >= 0:
            at = i + 1
        elif spare:
            spare -= 1
        else:
            return False
    return True


def _words(masks: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(m.to_bytes(MASK // 8, "little") for m in masks), np.uint64).reshape(-1, MASK // 64)


def _fulls(names: list[str], keys: list[str], asked: list[bool], least: float) -> Iterator[tuple[str, str]]:
    """Asked names with the first name, in falling order of length and letters, that holds them.

    Each letter of a name, by how often it came before, sets a bit. Bits of an
    alias that a name lacks are letters that it misses, so names, and blocks of
    them by all their bits, that lack more than an alias may miss are passed over.
    """
    order = sorted(range(len(names)), key=lambda i: (len(names[i]), names[i]), reverse=True)
    names, keys, asked = ([x[i] for i in order] for x in (names, keys, asked))
    sizes = [-len(x) for x in names]
    spares: dict[int, int] = {}
    many = len(names) > BLOCK
    if many:
        bits: defaultdict[tuple[str, int], int] = defaultdict(lambda: 1 << len(bits) % MASK)
        masks = []
        for key in keys:
            mask, seen = 0, {}
            for c in key:
                seen[c] = k = seen.get(c, 0) + 1
                mask |= bits[c, k]
            masks.append(mask)
        rows = _words(masks)
        blocks = np.bitwise_or.reduceat(rows, np.arange(0, len(rows), BLOCK))
    for i, key in enumerate(keys):
        n = len(key)
        if not asked[i] or n < ALIAS_LEAST:
            continue
        if n not in spares:
            spares[n] = max(m for m in range(n + 1) if (n - m) / n >= least)
        longer, spare = bisect_left(sizes, sizes[i]), spares[n]

        def near(of: np.ndarray) -> list[int]:
            return np.flatnonzero(np.bitwise_count(rows[i] & ~of).sum(axis=1, dtype=np.int64) <= spare).tolist()

        if not many:
            some = iter(range(longer))
        else:
            some = (b * BLOCK + j for b in near(blocks[: -(-longer // BLOCK)]) for j in near(rows[b * BLOCK : min(longer, b * BLOCK + BLOCK)]))
        full = next((j for j in some if _within(key, keys[j], spare)), None)
        if full is not None:
            yield names[i], names[full]


def alias_links(orgs: DataFrame, least: float = ALIAS_SHARE) -> DataFrame:
    """(doc_id, alias, full): the longest longer name of the document in which an alias stands, letter for letter in order, almost whole.

    Names are tried from the longest on, so an alias ends its search at the first
    one that holds it, and names without enough of its letters are never tried.
    A document of many names is dealt to several tasks by its aliases, at most
    `MOST_SHARES`; each has all names.
    """
    names = orgs.select("doc_id", F.col("text").alias("name")).where("doc_id IS NOT NULL AND name IS NOT NULL").distinct().withColumn("key", compact_name(F.col("name"))).where("key != ''")
    shares = F.least(F.ceil(F.count("*").over(Window.partitionBy("doc_id")) / SHARE_NAMES), F.lit(MOST_SHARES)).cast("int")
    dealt = names.withColumn("of", shares).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.select("doc_id", "share", "name", "key", (F.pmod(F.xxhash64("name"), "of") == F.col("share")).alias("asked"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", "alias", "full"])

        kinds, found = [kind, pa.string(), pa.string()], []
        for (doc_id, _), group in groupby(rows(), key=lambda r: r[:2]):
            _, _, *own = zip(*group, strict=True)
            for alias, full in _fulls(*own, least) if len(own[0]) > 1 else ():
                found.append((doc_id, alias, full))
                if len(found) >= 10_000:
                    yield out()
                    found.clear()
        if found:
            yield out()

    kind = to_arrow_type(orgs.schema["doc_id"].dataType)
    schema = StructType([orgs.schema["doc_id"], StructField("alias", StringType()), StructField("full", StringType())])
    # with a fixed number of tasks: the table is small for the work that it makes, so it isn't put together again
    parts = int(orgs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "doc_id", "share").sortWithinPartitions("doc_id", "share").mapInArrow(linked, schema)
