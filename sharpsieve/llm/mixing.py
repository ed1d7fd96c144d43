"""Mixing by iterative proportional fitting: rake token weights, then sample documents.

Each of three marginals (source, language, topic) has a dict of target shares; a
value that isn't in its dict, or is null, belongs to the category "*" (share 0
if the dict doesn't name it; None: its own share of all tokens, the others scaled to what is left). So the table of cells has at most the product of
the dicts' sizes plus one each, whatever the data: it alone goes to the driver.
Shares of a marginal are taken relative to the categories that hold tokens. A
document's probability is its cell's raked weight divided by the cell's tokens, times
one factor for all, and 1 at most; the factor is such that the expected tokens are
`fraction` of all. A cell with too few tokens for its weight is taken whole, and what
it lacks is spread over the others. Documents are drawn by a hash of seed and id.

A document's topic is its form, read from the whole text in any language: counts of
numbers, symbols, words in capitals and lines (FORMS) against its words, the first that
passes its share, else prose. Any other column can be given instead (`topic_of`). The
targets, what raking and the whole cells made of them, and how far raking was off at its
end are reported (`report`).

Defined results: null text has 0 tokens; documents of a cell without tokens or
with target 0 get probability 0; equal ids get equal draws, a null id is drawn by
its text; other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharpsieve.llm.common import free_name

REST = "*"
#: Fixed shares of the registered query and of the pipeline's last stage.
SOURCES = {"src0": 0.15, "src1": 0.05, "src2": 0.05, "src3": 0.05, REST: 0.70}
LANGS = {"en": 0.50, "fr": 0.20, "de": 0.18, "es": 0.12, REST: None}
TOPICS = {"prose": 0.94, "symbols": 0.03, "capitals": 0.02, "lines": 0.005, "figures": 0.005, REST: 0.0}
FRACTION, ROUNDS, TOLERANCE = 0.5, 25, 1e-12


#: Forms of text: a pattern, and of how many words at most there is one occurrence; in this order.
FORMS = {"figures": ("[0-9]+", 4), "symbols": (r"[#$%&*+/<=>@\[\]^_`{|}~\\]", 4), "capitals": ("[A-Z]{2,}", 4), "lines": (r"\n", 8)}
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def topic(counts: Mapping[str, Column], words: Column) -> Column:
    """The first form that passes its share, or prose. counts: occurrences of each form's pattern; lines are one more than their feeds."""
    found = None
    for name, (_, share) in FORMS.items():
        n = counts[name] + (1 if name == "lines" else 0)
        found = F.when(n * share > words, name) if found is None else found.when(n * share > words, name)
    return found.otherwise("prose")


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """tokens: one axis for each marginal. The fitted shares, summing to 1 (or to 0 without tokens)."""
    fitted = tokens / max(tokens.sum(), 1)
    for _ in range(rounds):
        worst = 0.0
        for axis, target in enumerate(targets):
            others = tuple(k for k in range(tokens.ndim) if k != axis)
            now = fitted.sum(axis=others)
            goal = np.where(now > 0, target, 0.0)
            goal = goal / goal.sum() if goal.sum() > 0 else goal
            factor = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            worst = max(worst, float(np.abs(goal - now).max(initial=0.0)))
            fitted = fitted * np.expand_dims(factor, others)
        if worst < tolerance:
            break
    return fitted


def probabilities(tokens: np.ndarray, share: np.ndarray, fraction: float) -> np.ndarray:
    """min(1, factor * share / tokens) for each cell, with expected tokens of `fraction` of all, or all of the cells with a share if they hold less."""
    rate = np.divide(share, tokens, out=np.zeros_like(share), where=tokens > 0)
    order = np.argsort(-rate, axis=None, kind="stable")
    order = order[rate.ravel()[order] > 0]
    own, weight, steep = tokens.ravel()[order], share.ravel()[order], rate.ravel()[order]
    factor = (fraction * tokens.sum() - (np.cumsum(own) - own)) / np.cumsum(weight[::-1])[::-1]  # if all cells before are taken whole
    fits = np.flatnonzero(factor * steep <= 1)
    return np.where(rate > 0, np.minimum(1.0, rate * factor[fits[0]]) if len(fits) else 1.0, 0.0)


def goal(shares: Mapping[str, float | None], own: np.ndarray) -> np.ndarray:
    """Target shares of a marginal; own: tokens of its categories, in the order of shares."""
    rest = own[list(shares).index(REST)] / max(own.sum(), 1) if shares[REST] is None else None
    out = np.array([0.0 if v is None else v for v in shares.values()], dtype=float)
    if rest is None:
        return out
    held = out[own > 0].sum()
    out = out * ((1 - rest) / held if held > 0 else 0.0)
    out[list(shares).index(REST)] = rest
    return out


def _figures(cats: list[list[str]], goals: list[np.ndarray], tokens: np.ndarray, share: np.ndarray, prob: np.ndarray) -> dict:
    """Of each marginal: target shares (of what there is), raked ones, and those of the expected draw; and the largest gap of raking."""
    out: dict = {"off": 0.0}
    for axis, name in enumerate(("source", "lang", "topic")):
        others = tuple({0, 1, 2} - {axis})
        target = np.where(tokens.sum(axis=others) > 0, goals[axis], 0.0)
        target = target / target.sum() if target.sum() > 0 else target
        raked, drawn = share.sum(axis=others), (tokens * prob).sum(axis=others)
        out["off"] = max(out["off"], float(np.abs(raked - target).max(initial=0.0)) if share.sum() > 0 else 0.0)
        drawn = drawn / drawn.sum() if drawn.sum() > 0 else drawn
        out[name] = {c: {"target": float(t), "raked": float(r), "drawn": float(d)} for c, t, r, d in zip(cats[axis], target, raked, drawn, strict=True)}
    return out


def mix(
    docs: DataFrame,
    *,
    sources: Mapping[str, float] = SOURCES,
    langs: Mapping[str, float | None] = LANGS,
    topics: Mapping[str, float] = TOPICS,
    topic_of: Column | None = None,
    fraction: float = FRACTION,
    seed: str = "mix",
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    report: dict | None = None,
) -> DataFrame:
    """docs with mix_source, mix_lang, mix_topic, n_tokens, weight, prob, selected (underscores in front if taken)."""
    names = {x: free_name(docs, x) for x in ("mix_source", "mix_lang", "mix_topic", "n_tokens", "weight", "prob", "selected")}
    wanted = [{**{REST: 0.0}, **x} for x in (sources, langs, topics)]
    keys = [names[x] for x in ("mix_source", "mix_lang", "mix_topic")]
    counted = docs.withColumn(names["n_tokens"], n_words(docs[text_col]))
    if topic_of is None:  # patterns are counted once a text, in a projection of their own
        held = {name: free_name(docs, f"n_{name}") for name in FORMS}
        counted = counted.withColumns({held[name]: F.coalesce(F.regexp_count(docs[text_col], F.lit(p)), F.lit(0)) for name, (p, _) in FORMS.items()})
        topic_of = topic({name: F.col(c) for name, c in held.items()}, F.col(names["n_tokens"]))
    values = [F.col("source"), F.col("lang"), topic_of]
    grouped = counted.withColumns({k: F.when(v.isin([x for x in w if x != REST]), v).otherwise(REST) for k, v, w in zip(keys, values, wanted, strict=True)})
    grouped = grouped.select(*docs.columns, *keys, names["n_tokens"])

    cats = [list(w) for w in wanted]
    tokens = np.zeros([len(c) for c in cats])
    for *cell, n in grouped.groupBy(*keys).agg(F.sum(names["n_tokens"]).alias("n")).collect():
        tokens[tuple(c.index(v) for c, v in zip(cats, cell, strict=True))] = n
    goals = [goal(w, tokens.sum(axis=tuple({0, 1, 2} - {axis}))) for axis, w in enumerate(wanted)]
    share = rake(tokens, goals, rounds)
    prob = probabilities(tokens, share, fraction)
    if report is not None:
        report |= _figures(cats, goals, tokens, share, prob)
    cells = [(*(c[i] for c, i in zip(cats, at, strict=True)), float(share[at]), float(prob[at])) for at in np.ndindex(*tokens.shape)]
    spark = docs.sparkSession
    rates = spark.createDataFrame(cells, ", ".join(f"`{k}` string" for k in (*keys,)) + f", `{names['weight']}` double, `{names['prob']}` double")
    text_id = F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary"))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), text_id).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    out = grouped.withColumn(names["selected"], draw).join(F.broadcast(rates), keys)
    out = out.withColumn(names["selected"], F.col(names["selected"]) < F.col(names["prob"]))
    return out.select(*docs.columns, *names.values())


def sample(docs: DataFrame, **options) -> DataFrame:
    """The drawn documents with the columns of mix."""
    out = mix(docs, **options)
    return out.where(F.col(out.columns[-1]))


def oracle(sources=SOURCES, langs=LANGS, topics=TOPICS, fraction=FRACTION, seed="mix", rounds=ROUNDS) -> str:
    """DuckDB SQL for the registered query; a pass of it for each round and marginal."""

    def goals(name: str, shares: Mapping[str, float | None]) -> str:
        rows = ", ".join(f"('{k}', {v or 0.0!r}::DOUBLE)" for k, v in {**{REST: 0.0}, **shares}.items())
        there = f"FROM (VALUES {rows}) t(k, v)"
        if shares.get(REST, 0.0) is not None:
            return f"goal_{name} AS (SELECT k, v / sum(v) OVER () AS v {there} WHERE k IN (SELECT {name} FROM f0))"
        own = f"(SELECT coalesce(sum(w), 0) AS r FROM f0 WHERE {name} = '{REST}')"
        return f"goal_{name} AS (SELECT k, CASE WHEN k = '{REST}' THEN r ELSE v * (1 - r) / sum(v) OVER () END AS v {there}, {own} WHERE k IN (SELECT {name} FROM f0))"

    def group(col: str, shares: Mapping[str, float]) -> str:
        inside = ", ".join(f"'{k}'" for k in shares if k != REST)
        return f"CASE WHEN {col} IN ({inside}) THEN {col} ELSE '{REST}' END"

    kind = "CASE " + " ".join(f"WHEN (n_{name}{' + 1' if name == 'lines' else ''}) * {share} > n THEN '{name}'" for name, (_, share) in FORMS.items()) + " ELSE 'prose' END"
    found = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) AS n_{name}" for name, p in {"words": _WORD, **{k: p for k, (p, _) in FORMS.items()}}.items())
    steps = [
        f"e AS (SELECT * RENAME (n_words AS n) FROM (SELECT doc_id, source, lang, {found} FROM documents))",
        f"d AS (SELECT doc_id, {group('source', sources)} AS s, {group('lang', langs)} AS l, {group(kind, topics)} AS t, n FROM e)",
        "c AS (SELECT s, l, t, sum(n)::DOUBLE AS n FROM d GROUP BY ALL)",
        "f0 AS (SELECT s, l, t, n / sum(n) OVER () AS w FROM c WHERE n > 0)",
        goals("s", sources), goals("l", langs), goals("t", topics),
    ]
    k = 0
    for _ in range(rounds):
        for m in "slt":
            steps.append(f"f{k + 1} AS MATERIALIZED (SELECT s, l, t, CASE WHEN sum(w) OVER (PARTITION BY {m}) > 0 THEN w * g.v / sum(w) OVER (PARTITION BY {m}) ELSE 0 END AS w FROM f{k} JOIN goal_{m} g ON g.k = f{k}.{m})")
            k += 1
    steps.append(f"r AS (SELECT s, l, t, w, n, w / n AS rate FROM f{k} JOIN c USING (s, l, t))")
    order = "ORDER BY rate DESC, s, l, t ROWS BETWEEN"
    steps.append(f"x AS (SELECT *, ({fraction} * (SELECT sum(n) FROM c) - coalesce(sum(n) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM r WHERE rate > 0)")
    steps.append("y AS (SELECT first(factor ORDER BY rate DESC, s, l, t) AS factor FROM x WHERE factor * rate <= 1)")
    steps.append("p AS (SELECT s, l, t, w, CASE WHEN rate > 0 THEN least(1, coalesce(rate * (SELECT factor FROM y), 1)) ELSE 0 END AS p FROM r)")
    return (
        "WITH " + ",\n".join(steps) + " SELECT d.doc_id, d.s AS mix_source, d.l AS mix_lang, d.t AS mix_topic, d.n::BIGINT AS n_tokens, round(coalesce(p.w, 0), 9) AS weight, round(coalesce(p.p, 0), 9) AS prob, "
        f"('0x' || substr(md5('{seed}|' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0 < coalesce(p.p, 0) AS selected FROM d LEFT JOIN p USING (s, l, t)"
    )
