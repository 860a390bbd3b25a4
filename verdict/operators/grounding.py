"""Whether the fields of a candidate stand in the text that they are said to come from: columns over field and text.

Texts compare after compatibility composition, case folding and collapsing of white space (`functions.text.folded_each`, one Arrow batch at
a time). A value that the text does not prove is not grounded: an amount or a date needs its label, and exactly one of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdict.functions.text import folded_each

# Labels, units, words of kinds and conditions, and what says that a rider is not enrolled.
DATE_LABELS = {
    "contract_start": r"계약(?:시작|개시)일|보험(?:시작|개시)일|contract start",
    "contract_end": r"계약(?:종료|만기)일|보험(?:종료|만기)일|contract end",
    "coverage_start": r"보장(?:시작|개시)일|coverage start",
    "coverage_end": r"보장(?:종료|만기)일|coverage end",
}
DATE = r"\s*[:：|]?\s*([0-9]{4})[-./년]\s*([0-9]{1,2})[-./월]\s*([0-9]{1,2})(?:일)?(?![0-9])"
UNITS = {"원": 1, "천원": 1000, "만원": 10000, "백만원": 1000000, "억원": 100000000}
AMOUNT = (
    r"(?:가입금액|보험가입금액|sum assured)\s*[:：|]?\s*"
    r"([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)\s*"
    r"(백만원|만원|천원|억원|원|KRW|USD|EUR|JPY)(?!\w)"
)
KINDS = {"fixed": ("정액", "fixed"), "indemnity": ("실손", "indemnity")}
RENEWABLE = {"true": ("갱신형", "renewable: true"), "false": ("비갱신", "비갱신형", "renewable: false")}
ISSUER = r"(?:보험사|보험회사|인수회사|발급회사|발급기관|발행기관|insurer|issuer)"
ENROLLED = r"(?:담보명|특약명|가입담보|가입특약|rider name|enrolled rider)"
TITLE_END = "_보험증권"
UNENROLLED = (
    r"^(?:미가입|미선택|가입\s*예시|not enrolled|example only)$",
    r"\s(?:미가입|미선택|가입\s*예시|not\s+enrolled|example\s+only)$",
    r"\((?:미가입|미선택|가입\s*예시)\)",
    r"^(?:이|해당)\s*(?:표|담보|특약)(?:는|은)?\s*(?:가입\s*예시|미가입|가입하지\s*않)",
    r"^미가입\s*(?:담보|특약)\s*(?:목록|내역)?$",
)
UNENROLLED_LINE = r"^\s*(?:미가입|미선택|not enrolled|example only)\s*$"
NOTICE = r"^\s*(?:이|해당)\s*표"
# Fixed values end.

MOST_EVIDENCE = 16
#: What splits lines.
LINES = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _stands(text: Column, before: str, own: Column, after: str) -> Column:
    """_like of a text and a value that are spaced already. Where the value is not in the text no pattern is made of it."""
    return F.coalesce((own != "") & F.contains(text, own) & F.regexp_like(text, F.concat(F.lit(f"(?U){before}"), _quoted(own), F.lit(after))), F.lit(False))


def _like(text: Column, before: str, value: Column, after: str) -> Column:
    """Whether a folded text has a folded value between two patterns; never for an empty value."""
    return _stands(spaced(text), before, spaced(value), after)


def _named(text: Column, own: Column) -> Column:
    """names of a text and a value that are spaced already."""
    return _stands(text, r"(?<!\w)", own, r"(?!\w)")


def names(text: Column, value: Column) -> Column:
    """Whether a folded text holds a folded value between word boundaries."""
    return _named(spaced(text), spaced(value))


def _once(x: Column, then: Callable) -> Column:
    """then(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, LINES, -1)


def issued(text: Column, value: Column) -> Column:
    """Whether a line of a folded text names the value as the issuer, by a label."""
    return F.exists(lines(text), lambda line: _like(line, rf"^{ISSUER}\s*[:：]\s*", value, r"(?:$|\s*[;|])"))


def titled(text: Column, value: Column) -> Column:
    """Whether a line of a folded text ends in the value and the label of a certificate."""
    return F.exists(lines(text), lambda line: _like(line, r"(?<!\w)", value, f"{TITLE_END}$"))


def enrolled(said: Column, text: Column, name: Column) -> Column:
    """Whether a folded and spaced text enrols a rider by name: after a label, or at its beginning beside the one amount (said: its `sums`)."""
    plain = F.regexp_replace(text, r"(?U)^\s*(?:(?:[0-9]+[.)]|[-•·])\s*)?", "")
    return _stands(text, rf"^{ENROLLED}\s*[:：]\s*", name, r"(?!\w)") | (_like(plain, "^", name, r"(?!\w)") & (F.size(said) == 1))


def unenrolled(text: Column) -> Column:
    """Whether a part of a text (between line ends, tabs and bars) says that something is not enrolled, or only an example."""
    parts = F.transform(F.split(text, r"[\n\t|]", -1), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.exists(parts, lambda p: p.rlike("(?iU)" + "|".join(f"(?:{u})" for u in UNENROLLED)))


def dated(text: Column, labels: str, value: Column) -> Column:
    """Whether exactly one date with such a label stands in the text, and it is the value."""
    pattern = f"(?iU)(?:{labels}){DATE}"

    def judged(said: Column) -> Column:
        part = lambda i: F.regexp_extract(F.get(said, F.lit(0)), pattern, i).try_cast("int")
        return (F.size(said) == 1) & (F.try_make_timestamp(part(1), part(2), part(3), F.lit(0), F.lit(0), F.lit(0)).cast("date") == value)

    return F.coalesce(_once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), judged), F.lit(False))


def sums(text: Column) -> Column:
    """The amounts with their label that stand in the text, as said."""
    return F.regexp_extract_all(text, F.lit(f"(?iU){AMOUNT}"), F.lit(0))


def priced(said: Column, amount: Column, currency: Column) -> tuple[Column, Column]:
    """Whether exactly one amount with its label stands in the text (said: its `sums`): the amount's grounding, with its unit word, and the currency's."""
    pattern, only = f"(?iU){AMOUNT}", F.get(said, F.lit(0))
    single = F.size(said) == 1
    unit = F.upper(F.regexp_extract(only, pattern, 2))
    times = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair)), unit), F.lit(1))
    number = F.regexp_replace(F.regexp_extract(only, pattern, 1), ",", "").try_cast("decimal(24,6)")
    of = F.when(unit.isin(*UNITS), "KRW").otherwise(unit)
    return F.coalesce(single & (number * times == amount), F.lit(False)), F.coalesce(single & (of == currency), F.lit(False))


def one_of(text: Column, value: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """Whether a folded and spaced text holds words of exactly one of the conditions, and it is the value."""
    has = {k: F.lit(False) for k in words}
    for k, own in words.items():
        for w in own:
            has[k] |= _named(text, F.lit(w))
    found, right = sum((h.cast("int") for h in has.values()), F.lit(0)), F.lit(False)
    for k, h in has.items():
        right |= (value == k) & h
    return F.coalesce((found == 1) & right, F.lit(False))


def kind(text: Column, value: Column) -> Column:
    """Whether the words of exactly one kind stand in a folded and spaced text, and it is the value; "unknown" always holds."""
    return F.coalesce(value == "unknown", F.lit(False)) | one_of(text, value, KINDS)


def _rider_texts(x: DataFrame) -> DataFrame:
    """x (_of_rider, text, _text_folded, _n: the folded name, spaced) with _row and _seen: of several enrolment rows in one text the one that
    names the rider, and it folded (empty where not exactly one does), or the whole text of what is no rider; and _excluded: whether a row of
    its own, the line after it or a notice says that it is not enrolled. Lines are those of a text before and after folding, one to one."""
    x = x.withColumn("_lines", lines(F.col("text"))).withColumn("_lines_folded", lines(F.col("_text_folded")))
    x = x.withColumn("_hits", F.when(F.col("_of_rider"), F.transform("_lines_folded", lambda line: _named(spaced(line), F.col("_n")))))
    own = F.col("_lines")
    x = x.withColumn("_rows", F.array_distinct(F.filter(own, lambda line, i: F.get("_hits", i))))
    after = F.filter(own, lambda line, i: (i > 0) & F.get("_hits", i - 1) & line.rlike(f"(?iU){UNENROLLED_LINE}"))
    notices = F.filter(own, lambda line: line.rlike(f"(?U){NOTICE}"))
    one, of_rider = F.size("_rows") == 1, F.col("_of_rider")
    excluded = of_rider & unenrolled(F.array_join(F.concat("_rows", after, notices), "\n"))
    seen = F.get(F.filter("_lines_folded", lambda line, i: F.get("_hits", i)), F.lit(0))
    return x.select(
        "*",
        F.when(~of_rider, F.col("text")).when(one, F.get("_rows", F.lit(0))).otherwise("").alias("_row"),
        F.when(~of_rider, F.col("_text_folded")).when(one, seen).otherwise("").alias("_seen"),
        F.coalesce(excluded, F.lit(False)).alias("_excluded"),
    ).drop("_lines", "_lines_folded", "_hits", "_rows")


def ground(fields: DataFrame, *, certificate_titles: bool = False, issuer_labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """The candidates (candidate, status, issue) of `grounded`, and their fields (candidate, position, field, value)."""
    out = grounded(fields, certificate_titles=certificate_titles, issuer_labels=issuer_labels)
    return out.select("candidate", "status", "issue"), out.select("candidate", F.inline("fields"))


def grounded(fields: DataFrame, *, certificate_titles: bool = False, issuer_labels: bool = False) -> DataFrame:
    """The candidates, judged by their texts: candidate, status, issue, fields (array of position, field, value).

    fields: candidate, kind (rider, policy_contract), status, position, field, value (text), text (all that is cited, line by line),
    primary (whether a primary policy source is cited), n_evidence, missing (whether a cited source is absent).

    Only candidates in status AI_VERIFIED are judged; one stays so if every field is grounded, else it is NEEDS_REVIEW with the issue
    of its first field that is not: NOT_ENROLLED or INVENTED_FIELD. A rider said not to be enrolled has the issue in any status.
    A rider without a kind of benefit gets "unknown", and a named kind that its enrolment line does not tell becomes so.

    A candidate's rows come together in one shuffle. What is read from a text is read once for all its fields that cite it.
    """
    # Short texts are dear to judge: they are dealt by number, not put together by size, and all that follows uses that.
    fields = fields.repartition(int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions")), "candidate")
    own = Window.partitionBy("candidate")
    name = F.max(F.when(F.col("field") == "rider_name", F.struct("value", "text", "primary", "n_evidence", "missing"))).over(own)
    x = fields.withColumn("_name", name["value"]).withColumn("_benefit", F.max(F.when(F.col("field") == "benefit_type", F.col("value"))).over(own)).withColumn("_last", F.max("position").over(own))
    x = x.withColumn("_rider", F.col("kind") == "rider")
    one = F.struct("position", "field", "value")
    added = F.struct((F.col("_last") + 1).alias("position"), F.lit("benefit_type").alias("field"), F.lit("unknown").alias("value"))
    gets = F.col("_rider") & F.col("_benefit").isNull() & (F.col("field") == "rider_name")
    x = x.groupBy("candidate", "kind", "status", "text", "primary", "n_evidence", "missing", "_name", "_benefit", "_rider").agg(F.flatten(F.collect_list(F.when(gets, F.array(one, added)).otherwise(F.array(one)))).alias("_fields"))
    x = x.withColumn("_unclassified", F.coalesce(F.col("_benefit"), F.when(F.col("_rider"), F.lit("unknown"))) == "unknown")
    x = x.withColumn("_folded", folded_each(F.concat(F.array("text", "_name"), F.transform("_fields", lambda f: f["value"]))))
    x = x.withColumn("_of_rider", F.coalesce(F.col("_rider") & F.col("_name").isNotNull(), F.lit(False)))
    x = x.withColumn("_text_folded", F.get("_folded", F.lit(0))).withColumn("_n", spaced(F.get("_folded", F.lit(1)))).withColumn("_values", F.slice("_folded", 3, F.greatest(F.size("_folded") - 2, F.lit(0))))
    x = _rider_texts(x)
    x = x.withColumn("_spaced", spaced(F.col("_seen"))).withColumn("_sums", sums(F.col("_row")))
    text, seen, plain, value, of_rider = F.col("_row"), F.col("_seen"), F.col("_spaced"), F.col("value"), F.col("_of_rider")
    x = x.withColumn("_line", of_rider & enrolled(F.col("_sums"), plain, F.col("_n")))
    each = F.inline(F.zip_with("_fields", "_values", lambda f, v: F.struct(f["position"].alias("position"), f["field"].alias("field"), f["value"].alias("value"), spaced(v).alias("_v"))))
    x = x.select("candidate", "kind", "status", "primary", "n_evidence", "missing", "_unclassified", "_of_rider", "_n", "_excluded", "_row", "_seen", "_spaced", "_sums", "_line", each)
    line = F.col("_line")
    any_kind = F.lit(False)
    for w in (w for own_words in KINDS.values() for w in own_words):
        any_kind |= _named(plain, F.lit(w))
    told = (F.col("field") == "benefit_type") & value.isin(*KINDS) & of_rider & line & ~any_kind
    x = x.withColumn("value", F.when(told, "unknown").otherwise(value))
    unnamed = (F.col("field") == "rider_name") & F.col("_unclassified") & of_rider & ~line
    key = lambda c: F.regexp_replace(c, r"(?U)[\W_]+", "")
    amount, currency = priced(F.col("_sums"), value.try_cast("decimal(24,6)"), value)
    field, said = F.col("field"), F.col("_v")
    proof = F.when(field.isin("rider_status", "policy_status"), value == "unknown")
    proof = proof.when(field == "insurer", _named(plain, said) & (issued(seen, said) if issuer_labels else F.lit(True)))
    proof = proof.when(field == "product_name", _named(plain, said) | (titled(seen, said) & (F.col("kind") == "policy_contract") if certificate_titles else F.lit(False)))
    proof = proof.when(field == "rider_name", _named(plain, said))
    proof = proof.when(field == "rider_key", (key(said) != "") & (key(said) == key(F.col("_n"))) & _named(plain, F.col("_n")))
    for which, labels in DATE_LABELS.items():
        proof = proof.when(field == which, dated(text, labels, value.try_cast("date")))
    proof = proof.when(field == "sum_assured", amount).when(field == "currency", currency).when(field == "benefit_type", kind(plain, value)).when(field == "renewable", one_of(plain, value, RENEWABLE))
    cited = F.col("primary") & ~F.col("missing") & F.col("n_evidence").between(1, MOST_EVIDENCE)
    issue = F.when(F.col("_excluded"), "NOT_ENROLLED").when(unnamed | ~F.coalesce(cited, F.lit(False)) | ~F.coalesce(proof, F.lit(False)), "INVENTED_FIELD")
    judged = x.select("candidate", "status", "position", "field", "value", F.col("field").eqNullSafe("rider_name").alias("_is_name"), "_excluded", "primary", issue.alias("issue"))
    out = judged.groupBy("candidate").agg(
        F.min("status").alias("_was"), F.min(F.when(F.col("issue").isNotNull(), F.struct("position", "issue"))).alias("_first"), F.coalesce(F.bool_or(F.col("_is_name") & F.col("_excluded") & F.col("primary")), F.lit(False)).alias("_out"),
        F.collect_list(F.struct("position", "field", "value")).alias("fields"),
    )
    verified = F.col("_was") == "AI_VERIFIED"
    code = F.when(F.col("_out"), "NOT_ENROLLED").when(verified, F.col("_first.issue"))
    return out.select("candidate", F.when(verified & code.isNotNull(), "NEEDS_REVIEW").otherwise(F.col("_was")).alias("status"), code.alias("issue"), "fields")
