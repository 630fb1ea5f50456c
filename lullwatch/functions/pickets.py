"""Position of a sensor along its tunnel, read from the sensor name.

A picket is ten metres; "ПК447+5" is 4475 m on the main axis. A picket after a gallery mark lies in a side gallery.
A name becomes a list of tokens, and the order of their kinds (a short text, one letter a token) says what a picket means:

    P picket            N bare number       R dash              W anything else
    g "Г1"              a "ГАЛ." without a number               (both also open a name or follow white space)
    h, b                the same two after a bracket, comma or semicolon
    n "ГАЛ.172"         x any other gallery mark
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullwatch.operators.columns import settle

PICKET_M = 10.0
NUMBER = r"\d+(?:[.,]\d+)?"
LENGTH = rf"{NUMBER}(?:\s*\+\s*{NUMBER})?"
NO_PICKET, LETTERS = r"(?!ПК\s*\d)", "[А-ЯЁ]"
MARK = rf"[\s(,;]?(?:ГАЛ(?:{NO_PICKET}{LETTERS})*|Г)\s*\.?\s*(?:\d+|{NO_PICKET}{LETTERS}{{2,}}(?=[\s.]*ПК\s*\d))?"
TOKEN = "|".join([rf"ПК\s*{LENGTH}", MARK, LENGTH, "-", rf"(?:{NO_PICKET}[А-ЯЁA-Z0-9])+", r"[^\s.]"])
KINDS = (
    (r"^ПК\s*\d", "P"), (r"^\d", "N"), ("^-$", "R"), (r"^\s?ГАЛ\.?\s*\d+$", "n"),
    (r"^\sГ\s*\.?\s*\d+$", "g"), (rf"^\sГАЛ{LETTERS}*\s*\.?\s*$", "a"),
    (r"^[(,;]Г\s*\.?\s*\d+$", "h"), (rf"^[(,;]ГАЛ{LETTERS}*\s*\.?\s*$", "b"),
    (rf"^\s?(?:ГАЛ{LETTERS}*|Г)\s*\.?\s*(?:\d+|{LETTERS}{{2,}})?$", "x"),
)
MARKS = (("side", rf"[^А-ЯЁ]ЛЕВ", "left"), ("side", rf"[^А-ЯЁ]ПРАВ", "right"),
         ("feature", r"[^А-ЯЁ]ВШ(?:[^А-ЯЁ]|$)", "ВШ"), ("feature", "АНС", "АНС"), ("feature", "ЩИТ", "щит"))


def _kind(token: Column) -> Column:
    return F.coalesce(*[F.when(token.rlike(pattern), kind) for pattern, kind in KINDS], F.lit("W"))


def _metres(token: Column) -> Column:
    """"ПК176+6,5" or "184" in metres."""
    part = lambda pattern: F.translate(F.regexp_extract(token, pattern, 1), ",", ".").try_cast("double")
    return part(rf"({NUMBER})") * PICKET_M + F.coalesce(part(rf"\+\s*({NUMBER})"), F.lit(0.0))


def _mark_name(token: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(token, rf"^[\s(,;]?(?:ГАЛ{LETTERS}*|Г)\s*\.?\s*", "")), F.lit("")), F.lit("?"))


def parse_pickets(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``main_m, gallery, gallery_m, range_from, range_to, side, feature, level`` (NULL where absent)."""
    text = F.concat(F.lit(" "), F.translate(F.upper(F.coalesce(F.col(name), F.lit(""))), "–—", "--"))
    df = settle(df, {"_t": text})
    df = settle(df, {"_tok": F.regexp_extract_all("_t", F.lit(TOKEN), F.lit(0))})
    df = settle(df, {"_order": F.array_join(F.transform("_tok", _kind), "")})
    t, order = F.col("_t"), F.col("_order")
    found = lambda pattern: F.regexp_instr(order, F.lit(pattern))
    # axis then gallery; picket in a gallery whose own picket stands in the mark; gallery alone; span; any picket
    df = settle(df, {"_branch": found("P[ganx]P"), "_turned": found("Pn(?!P)"), "_span": found("PR[PN]"), "_any": found("P"),
                     "_alone": order.rlike("^[^P]*[gahb]P") & ~t.contains("РАЗВИЛК")})
    token = lambda at, step=0: F.get("_tok", F.col(at) + (step - 1))
    branch, turned = F.col("_branch") > 0, F.col("_turned") > 0
    alone, single = F.col("_alone"), F.col("_any") > 0
    on_axis = (F.col("_span") > 0) & ~branch & ~turned & ~alone
    ends = _metres(token("_span")), _metres(token("_span", 2))
    marks = {c: F.coalesce(*[F.when(t.rlike(p), v) for k, p, v in MARKS if k == c]) for c in ("side", "feature")}
    return settle(df, {
        "main_m": F.when(branch, _metres(token("_branch"))).when(turned, _metres(token("_turned", 1))).when(single & ~alone, _metres(token("_any"))),
        "gallery": F.when(branch, _mark_name(token("_branch", 1))).when(turned, "?").when(alone, _mark_name(token("_any", -1))),
        "gallery_m": F.when(branch, _metres(token("_branch", 2))).when(turned, _metres(token("_turned"))).when(alone, _metres(token("_any"))),
        "range_from": F.when(on_axis, F.least(*ends)), "range_to": F.when(on_axis, F.greatest(*ends)),
        **marks, "level": F.regexp_extract(t, r"УР\.?\s*(\d)", 1).try_cast("int"),
    }).drop("_t", "_tok", "_order", "_branch", "_turned", "_span", "_any", "_alone")
