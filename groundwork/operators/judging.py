"""Judging answers: verdicts out of probabilities or fixed sentences, labels and their overrides, and the measures of judges and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.text import judge_norm
from groundwork.operators.measuring import LABELS, rate

#: Options of the decision step and of the judge, in the order that settles ties.
OPTIONS = {"A": "A", "B": "B", "C": "C"}
VERDICT_OPTIONS = {"A": "richtig", "B": "teilweise", "C": "falsch", "D": "unsicher"}
#: The sentences that refuse, as the system itself writes them.
NOT_CLEAR = "In den gefundenen Stellen steht das nicht eindeutig."
NOTHING = "In den gefundenen Stellen steht dazu nichts."
NEAREST = "Naechste Fundstellen:"
PARTLY = "Hinweis: nur teilweise belegt"


def option_letter(token: Column) -> Column:
    """A token such as `` a)`` as a bare capital letter."""
    return F.upper(F.trim(F.regexp_replace(F.trim(token), r"[).:]+$", "")))


def option_shares(tokens: Column, options: dict[str, str]) -> Column:
    """Map of class to share, out of an array of (token, logprob) of the first token; null where no option is among them.

    Spellings of one option add up; what other tokens take is left out of the shares.
    """
    letters = list(options)

    def taken(letter: str) -> Column:
        of = F.filter(tokens, lambda t: option_letter(t["token"]) == letter)
        return F.aggregate(of, F.lit(0.0), lambda s, t: s + F.exp(t["logprob"].cast("double")))

    mass = [taken(x) for x in letters]
    total = reduce(lambda a, b: a + b, mass)
    shares = F.create_map(*[c for x, m in zip(letters, mass) for c in (F.lit(options[x]), m / total)])
    return F.when(F.size(tokens) > 0, F.when(total > 0, shares))


def option_rest(tokens: Column, options: dict[str, str]) -> Column:
    """Probability that none of the options takes, at least 0."""
    of = F.filter(tokens, lambda t: option_letter(t["token"]).isin(*options))
    return F.greatest(F.lit(0.0), 1 - F.aggregate(of, F.lit(0.0), lambda s, t: s + F.exp(t["logprob"].cast("double"))))


def best_option(shares: Column, options: dict[str, str], otherwise: str | None = None) -> Column:
    """The class with the largest share, ties in the order of ``options``; ``otherwise`` where there are no shares."""
    names = list(options.values())
    top = F.array_max(F.array(*[F.try_element_at(shares, F.lit(n)) for n in names]))
    pick = F.coalesce(*[F.when(F.try_element_at(shares, F.lit(n)) == top, n) for n in names])
    return F.coalesce(pick, F.lit(otherwise)) if otherwise else pick


def composed_answer(option: Column, answer: Column, pages: Column) -> Column:
    """The answer as given (A), with a hint to the pages (B), or a fixed sentence with them instead of it (C)."""
    from groundwork.operators.books import page_list

    listed = page_list(pages)
    none = F.when(F.size(pages) > 0, F.concat(F.lit(f"{NOTHING} {NEAREST} "), listed, F.lit("."))).otherwise(NOTHING)
    hint = F.when(F.size(pages) > 0, F.concat(F.lit(f"\n\n{PARTLY} -- pruef "), listed, F.lit("."))).otherwise(f"\n\n{PARTLY}.")
    return F.when(option == "C", none).when(option == "B", F.concat(answer, hint)).otherwise(answer)


def is_fixed_refusal(answer: Column) -> Column:
    """Whether an answer is nothing but a fixed refusing sentence, with or without a list of pages."""
    page, spoken = r"s\.\s*\d+", r"seite\s+\d+"
    listed = rf"(?:\s+naechste fundstellen:\s+(?:{page}(?:\s*,\s*{page})*|{spoken}(?:(?:\s*,\s*|\s+und\s+){spoken})*)\.?)?"
    clear = rf"in den gefundenen stellen steht das nicht eindeutig\.(?:\s+schau auf seite\s+\d+(?:(?:\s*,\s*|\s+und\s+)\d+)*\s+nach\.)?"
    return F.coalesce(judge_norm(answer).rlike(rf"^(?:{clear}|in den gefundenen stellen steht dazu nichts\.){listed}\z"), F.lit(False))


def deterministic_verdict(answer: Column, refusal_expected: Column) -> Column:
    """``richtig`` or ``unsicher`` for a fixed refusal, without asking any judge; null for every other answer."""
    return F.when(is_fixed_refusal(answer), F.when(F.coalesce(refusal_expected, F.lit(False)), "richtig").otherwise("unsicher"))


def with_overrides(rows: DataFrame, overrides: DataFrame, line: str = "zeile") -> DataFrame:
    """Labels replaced by line: ``label``, ``label_original``, ``override`` and ``fehlerart``.

    ``overrides`` has ``zeile, neu`` and ``fehlerart`` (null: none named). A kind of error goes where the
    new label is not ``falsch`` and none is named. A line twice or outside the rows is an error.
    """
    o = overrides.select(F.col(line), F.col("neu").alias("_n"), F.col("fehlerart").alias("_f"))
    bad = o.groupBy(line).count().where("count > 1").select(line).unionByName(o.select(line).join(rows, line, "left_anti"))
    if found := [r[0] for r in bad.limit(5).collect()]:
        raise ValueError(f"overrides name these lines twice or beyond the rows: {found}")
    if found := [r[0] for r in o.where(~F.col("_n").isin(*LABELS)).select("_n").limit(5).collect()]:
        raise ValueError(f"overrides use unknown labels: {found}")
    j = rows.join(o, line, "left")
    kind = F.when(F.col("_n").isNull(), F.col("fehlerart")).otherwise(F.coalesce("_f", F.when(F.col("_n") == "falsch", F.col("fehlerart"))))
    return j.withColumn("label_original", F.when(F.col("_n").isNotNull(), F.col("label"))).withColumn("override", F.col("_n").isNotNull()).withColumn("label", F.coalesce("_n", "label")).withColumn("fehlerart", kind).drop("_n", "_f")


def rate_blocks(rows: DataFrame) -> DataFrame:
    """(block, ebene, gruppe, zaehler, nenner, quote): four rates of mistaken verdicts, in all, by kind of error and by collection.

    ``rows`` has ``label, urteil, fehlerart, spiel_id``. One pass: the rows of a block are tagged, and the
    three groupings are sets of one aggregation.
    """
    label, verdict = F.col("label"), F.col("urteil")
    blocks = {
        "durchgewunken": (label == "falsch", verdict == "richtig"), "abgelehnt": (label == "richtig", verdict == "falsch"),
        "falsch_nicht_erkannt": (label == "falsch", verdict != "falsch"), "richtig_nicht_erkannt": (label == "richtig", verdict != "richtig"),
    }
    tags = F.array(*[F.when(of, F.struct(F.lit(n).alias("block"), F.coalesce(hit, F.lit(False)).alias("hit"))) for n, (of, hit) in blocks.items()])
    d = rows.select(F.coalesce("fehlerart", F.lit("-")).alias("art"), "spiel_id", F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("t"))
    d = d.select("t.block", "t.hit", F.explode(F.array(F.struct(F.lit("gesamt").alias("ebene"), F.lit("").alias("gruppe")), F.struct(F.lit("fehlerart").alias("ebene"), F.col("art").alias("gruppe")), F.struct(F.lit("spiel").alias("ebene"), F.col("spiel_id").alias("gruppe")))).alias("g"))
    g = d.groupBy("block", "g.ebene", "g.gruppe").agg(F.count_if("hit").alias("zaehler"), F.count(F.lit(1)).alias("nenner"))
    return g.withColumn("quote", F.round(rate(F.col("zaehler"), F.col("nenner")), 6))


def unsure_split(rows: DataFrame) -> DataFrame:
    """(name, zaehler, nenner, quote) of how ``unsicher`` is taken for other verdicts and they for it; null where nothing was counted."""
    of = {"unsicher_als_falsch": ("unsicher", "falsch"), "unsicher_als_richtig": ("unsicher", "richtig"), "falsch_als_unsicher": ("falsch", "unsicher"), "richtig_als_unsicher": ("richtig", "unsicher")}
    one = rows.agg(*[c for n, (a, b) in of.items() for c in (F.count_if((F.col("label") == a) & (F.col("urteil") == b)).alias(f"{n}_z"), F.count_if(F.col("label") == a).alias(f"{n}_n"))])
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_z").alias("zaehler"), F.col(f"{n}_n").alias("nenner")) for n in of])
    return one.select(F.explode(parts).alias("p")).select("p.*").withColumn("quote", F.round(rate(F.col("zaehler"), F.col("nenner")), 6))


def disputed_split(rows: DataFrame) -> DataFrame:
    """One row: how many rows count, how many are disputed, and the shares of unusable and of deterministic verdicts; the last over all rows."""
    d, u = F.coalesce("strittig", F.lit(False)), F.col("urteil") == "unparsebar"
    one = rows.agg(F.count_if(~d).alias("haupt"), F.count_if(d).alias("strittig"), F.count_if(~d & u).alias("unparsebar"), F.count_if(F.coalesce("deterministisch", F.lit(False))).alias("deterministisch"), F.count(F.lit(1)).alias("alle"))
    return one.withColumn("quote_unparsebar", F.round(rate(F.col("unparsebar"), F.col("haupt")), 6)).withColumn("quote_deterministisch", F.round(rate(F.col("deterministisch"), F.col("alle")), 6))


def latency(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, median, max) of ``sekunden``, without null ones and verdicts no judge gave."""
    d = rows.where(F.col("sekunden").isNotNull() & ~F.coalesce("deterministisch", F.lit(False)))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("sekunden"), 6).alias("median"), F.max("sekunden").alias("max"))


def token_cost(rows: DataFrame, usd_in: float, usd_out: float, *by: str) -> DataFrame:
    """Sums, typical and largest numbers of tokens, and cost at the given prices of a million tokens; rows without numbers and deterministic ones don't count."""
    d = rows.where("eingabe is not null and ausgabe is not null").where(~F.coalesce("deterministisch", F.lit(False)))
    cost = (F.col("eingabe") * usd_in + F.col("ausgabe") * usd_out) / 1e6
    aggs = [F.count(F.lit(1)).alias("n")]
    for c, n in ((F.col("eingabe"), "eingabe"), (F.col("ausgabe"), "ausgabe"), (cost, "kosten")):
        aggs += [F.round(F.sum(c), 6).alias(f"{n}_summe"), F.round(F.median(c), 6).alias(f"{n}_typisch"), F.round(F.max(c), 6).alias(f"{n}_max")]
    return d.groupBy(*by).agg(*aggs)


def setting_span(rows: DataFrame, setting: str, run: str) -> DataFrame:
    """(setting, laeufe, min, max, median_s, max_s): least and largest precision of a setting's runs, and times over all its verdicts."""
    per = rows.groupBy(setting, run).agg(F.count_if(F.col("urteil") == "richtig").alias("r"), F.count_if(F.col("urteil") != "unsicher").alias("n"))
    q = rate(F.col("r"), F.col("n"))
    spans = per.groupBy(setting).agg(F.count(F.lit(1)).alias("laeufe"), F.round(F.min(q), 6).alias("treffsicherheit_min"), F.round(F.max(q), 6).alias("treffsicherheit_max"))
    t = F.when(F.col("sekunden") >= 0, F.col("sekunden"))
    times = rows.groupBy(setting).agg(F.round(F.median(t), 6).alias("median_s"), F.max(t).alias("max_s"))
    return spans.join(times, setting)


def unequal_runs(rows: DataFrame, setting: str, run: str, question: list[str]) -> DataFrame:
    """(setting, run, fehlt): questions that a setting has but one of its runs lacks; repetitions compare only where this is empty."""
    runs = rows.groupBy(setting).agg(F.count_distinct(run).alias("alle"))
    per = rows.groupBy(setting, *question).agg(F.collect_set(run).alias("_r"), F.count_distinct(run).alias("n")).join(runs, setting).where("n < alle")
    names = rows.select(setting, run).distinct()
    gone = per.join(names, setting).where(~F.array_contains("_r", F.col(run)))
    return gone.groupBy(setting, run).agg(F.count(F.lit(1)).alias("fehlt"))
