"""Rule-based classification of theme candidates, as one CASE chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.keys import product_code
from docweave.functions.text import sentences

# Tiers, chapters by tag, important section words, and the patterns of the two themes.
FORBIDDEN, STOP, OTHER, OWN = 0, 1, 2, 3
CHAPTERS = {
    "Warnings": "1. 警告",
    "ContraIndications": "2. 禁忌",
    "EfficacyRelatedPrecautions": "5. 効能又は効果に関連する注意",
    "InfoPrecautionsDosage": "7. 用法及び用量に関連する注意",
    "ImportantPrecautions": "8. 重要な基本的注意",
    "UseInSpecificPopulations": "9. 特定の背景を有する患者に関する注意",
    "Interactions": "10. 相互作用",
    "PrecautionsForApplication": "14. 適用上の注意",
    "OtherPrecautions": "15. その他の注意",
}
STOP_CHAPTERS = ("Warnings", "InfoPrecautionsDosage", "ImportantPrecautions", "UseInSpecificPopulations", "Interactions")
OTHER_CHAPTERS = ("Warnings", "ImportantPrecautions", "UseInSpecificPopulations", "Interactions", "OtherPrecautions")
_ACT = (
    r"中止|休薬|中断|延期|投与しない|投与を避け|投与は避け|投与を控え|使用しない|使用を避け|投与を行わない|切り替え|切り換え"
    r"|(?:時間|日|週間?|ヵ月|か月)(?:以上)?(?:経過|前|以内)"
)


@dataclass(frozen=True)
class Theme:
    """net: what is collected; term, ignored: what a sentence is about; act: that something is to be done; users: classes that use it."""

    net: str
    term: str
    ignored: str
    act: str
    users: tuple[str, ...] = ()
    own_code: str | None = None
    own_class: str | None = None


THEMES = {
    "shujutsu": Theme(
        net=r"手術|術[前中後]|周術期",
        term=r"手術|(?<![一-龥])術[前中後]|周術期",
        ignored=r"〈[^〉]*〉|[A-Za-zＡ-Ｚａ-ｚ一-龥]*手術施行(?:後|患者)|手術不能|手術不可能|術[前後](?:・術後)?(?:補助|薬物療法)|手術の補助療法"
        r"|術後(?:疼痛|鎮痛|感染|悪心|嘔吐|回復液|放射線|イレウス)|手術等による|緊急手術が必要"
        r"|手術(?:の)?既往|手術歴|手術療法|手術適応|手術野|手術部位|手術創",
        act=_ACT + r"|増量|手術を予定|手術が予定|手術予定|術前又は",
        users=("111", "112", "121", "122"),
    ),
    "zouei": Theme(net=r"造影", term=r"造影剤", ignored=r"〈[^〉]*〉|造影剤を混和|造影剤等により薬剤の分布", act=_ACT + r"|再開|減量", own_code="72", own_class="造影"),
}


def about(text: Column, theme: Theme) -> Column:
    """the term stands outside what is ignored."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), theme.ignored, "").rlike(theme.term)


def classified(candidates: DataFrame, theme: Theme) -> DataFrame:
    """Rows (u, cls, ch, p, t, b, own, row) with their tier k and the sentences s; those of no tier go."""
    code = product_code(F.col("u"))
    group = F.substring(code, 1, 3)
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("ch", "p", "t", "b", "cls")}
    flag = {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1 for c in ("own", "row")}
    own_document = F.lit(False)
    if theme.own_code is not None:
        own_document = F.startswith(code, F.lit(theme.own_code)) & F.contains(text["cls"], F.lit(theme.own_class))
    said = sentences(text["t"])
    found = F.when(flag["row"], F.when(F.size(said) > 0, said).otherwise(F.array(text["p"]))).otherwise(F.filter(said, lambda s: about(s, theme)))
    out = candidates.withColumn("s", F.when(flag["own"], F.array().cast("array<string>")).otherwise(found))
    acts = F.exists(F.concat(F.col("s"), sentences(text["b"])), lambda s: s.rlike(theme.act))
    user = group.isin(*theme.users) if theme.users else F.lit(False)
    tier = (
        F.when(flag["own"], F.when((text["t"] != "") | (text["b"] != ""), OWN))
        .when(own_document, None)
        .when(flag["row"] & ~about(text["p"], theme), None)
        .when(F.size("s") == 0, None)
        .when(user & (text["ch"] == "InfoPrecautionsDosage"), None)
        .when(text["ch"] == "ContraIndications", FORBIDDEN)
        .when(text["ch"].isin(*STOP_CHAPTERS) & acts, STOP)
        .when(text["ch"].isin(*OTHER_CHAPTERS) & ~user, OTHER)
    )
    names = F.create_map(*[F.lit(x) for pair in CHAPTERS.items() for x in pair])
    return out.withColumn("k", tier).where("k IS NOT NULL").withColumn("chapter", F.coalesce(F.try_element_at(names, F.col("ch")), F.col("ch")))


def important(top: Column, words: list[str]) -> Column:
    """Any word in the first element of a path."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(top, F.lit(w))
    return F.coalesce(out, F.lit(False))


def tier_counts(df: DataFrame, tier: str, shown: list[int]) -> DataFrame:
    """Rows of each tier, and how many of all are hidden."""
    counts = df.groupBy(tier).agg(F.count("*").alias("n"))
    return counts.withColumn("shown", F.col(tier).isin(*shown)).withColumn("n_hidden", F.when(F.col("shown"), 0).otherwise(F.col("n")))
