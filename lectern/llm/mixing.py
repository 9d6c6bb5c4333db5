"""Mixing sources to target weights: token totals raked to margins, then documents drawn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "*"
# Shares of tokens that the mix shall have. What a margin does not name is its rest.
TARGETS = {
    "source": {"src0": 0.15, REST: 0.85},
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.11, REST: 0.01},
    "topic": {"prose": 0.86, REST: 0.14},
}
SWEEPS = 20
# Share of the tokens that the mix has at least; a category that falls short even of it is taken whole.
LEAST = 0.1
BOUNDED_SWEEPS = 200
SEED = 6
DIGITS = 13
# A text that holds one of these is of that topic, the first that fits; else prose.
TOPICS = (("licence", "icense"), ("contact", "@"), ("list", " | "))


def topic(text: Column) -> Column:
    out = None
    for name, sign in TOPICS:
        here = F.contains(text, F.lit(sign))
        out = F.when(here, name) if out is None else out.when(here, name)
    return out.when(F.rlike(text, F.lit("[0-9]")), "figures").otherwise("prose")


def token_count(text: Column) -> Column:
    """Words between white space."""
    words = F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "")
    return F.coalesce(F.size(words), F.lit(0)).cast("bigint")


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / float(16 ** DIGITS)


def rake(totals: dict[tuple[str, ...], float], targets: list[dict[str, float]],
         sweeps: int = SWEEPS) -> dict[tuple[str, ...], float]:
    """Weight of a token of each cell after iterative proportional fitting to the margins.

    ``totals``: tokens by one category of each margin. Each step scales the cells of a category so that
    their sum is its target; categories without tokens are left out, and their share goes to the others
    in proportion.
    """
    cells = [c for c, n in totals.items() if n > 0]
    tokens = np.array([float(totals[c]) for c in cells])
    weight, whole = tokens.copy(), tokens.sum()
    for _ in range(sweeps):
        for k, target in enumerate(targets):
            names = np.array([c[k] for c in cells])
            present = sorted(set(names.tolist()))
            share = sum(target[x] for x in present)
            for name in present:
                here = names == name
                now = weight[here].sum()
                if now > 0 and share > 0:
                    weight[here] *= target[name] / share * whole / now
    return dict(zip(cells, (weight / tokens).tolist())) if cells else {}


def scarce(totals: dict[tuple[str, ...], float], targets: list[dict[str, float]], least: float = LEAST,
           ) -> set[tuple[str, ...]]:
    """The cells of categories whose tokens are fewer than their target in a mix of ``least`` of all."""
    left = {c: n for c, n in totals.items() if n > 0}
    while True:
        short, whole = set(), sum(left.values())
        for k, target in enumerate(targets):
            sums: dict[str, float] = {}
            for c, n in left.items():
                sums[c[k]] = sums.get(c[k], 0) + n
            share = sum(target[x] for x in sums)
            short |= {c for c in left if share * sums[c[k]] < target[c[k]] * least * whole}
        if not short:
            return {c for c, n in totals.items() if n > 0} - left.keys()
        left = {c: n for c, n in left.items() if c not in short}


def rake_within(totals: dict[tuple[str, ...], float], targets: list[dict[str, float]], budget: float,
                sweeps: int = BOUNDED_SWEEPS) -> dict[tuple[str, ...], float]:
    """Probabilities of at most 1 with which ``budget`` tokens are drawn and the margins are met.

    Each step scales the cells of a category so that, each cut at its tokens, their sum is the target;
    the scales are kept uncut, so the fit is the one nearest to the tokens. Where margins contradict each
    other at this budget the last one is met, as far as tokens reach.
    """
    cells = list(totals)
    tokens = np.array([float(totals[c]) for c in cells])
    scale = np.full(len(cells), budget / tokens.sum())
    for _ in range(sweeps):
        for k, target in enumerate(targets):
            names = np.array([c[k] for c in cells])
            present = sorted(set(names.tolist()))
            share = sum(target[x] for x in present)
            for name in present:
                here = np.flatnonzero(names == name)
                # the cells that are cut first, in order: sums of those cut and of those that are not
                here = here[np.argsort(-scale[here], kind="stable")]
                cut = np.concatenate([[0.0], np.cumsum(tokens[here])])
                free = (tokens[here] * scale[here])[::-1].cumsum()[::-1]
                want = target[name] / share * budget if share > 0 else tokens[here].sum()
                steps = (want - cut[:-1]) / free
                fits = np.flatnonzero(steps * scale[here] <= 1)
                step = steps[fits[0]] if len(fits) else 1 / scale[here].min()
                scale[here] = np.clip(scale[here] * max(step, 0.0), 1e-12, 1e12)
    return dict(zip(cells, np.minimum(scale, 1.0).tolist()))


def probabilities(totals: dict[tuple[str, ...], float], targets: list[dict[str, float]],
                  least: float = LEAST) -> dict[tuple[str, ...], float]:
    """The probability of a token of each cell: targets met without need of a document twice.

    Scarce categories are taken whole, and their share goes to the others in proportion. The rest is as
    large as it can be with every cell at its raked weight, which is what the largest weight allows; if
    that is less than ``least`` of its tokens, it has ``least`` of them, raked with probabilities cut at 1.
    """
    short = scarce(totals, targets, least)
    rest = {c: n for c, n in totals.items() if n > 0 and c not in short}
    weights = rake(rest, targets)
    most = max(weights.values(), default=1.0)
    if most * least > 1:
        found = rake_within(rest, targets, least * sum(rest.values()))
    else:
        found = {c: w / most for c, w in weights.items()}
    return found | dict.fromkeys(short, 1.0)


def share(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> Column:
    """A column: the probability of each document of ``docs`` (text, source, lang) under the targets.

    Documents count by their words. Token totals by category are summed up over all documents; there are
    as many cells as the targets name, so they fit on the driver, where ``probabilities`` are found.
    """
    targets = targets or TARGETS
    for name, target in targets.items():
        if REST not in target:
            raise ValueError(f"the target of {name} has no rest")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def category(name: str) -> Column:
        column = topic(text) if name == "topic" else F.col(name).cast("string")
        return F.when(column.isin([x for x in targets[name] if x != REST]), column).otherwise(REST)

    cell = F.concat_ws("\n", *[category(name) for name in targets])
    sums = docs.groupBy(cell.alias("cell")).agg(F.sum(token_count(text)).alias("tokens")).collect()
    found = probabilities(
        {tuple(r["cell"].split("\n")): r["tokens"] for r in sums}, list(targets.values()))
    if not found:
        return F.lit(1.0)
    pairs = [F.lit(x) for c, p in found.items() for x in ("\n".join(c), round(p, 12))]
    # a text without words costs nothing
    return F.when(token_count(text) == 0, 1.0).otherwise(F.element_at(F.create_map(*pairs), cell))


def draw(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = SEED) -> DataFrame:
    """The documents (doc_id, text, source, lang) that are drawn, with all their columns.

    A document is drawn if the hash of its id is below its probability. Null and unnamed categories are
    the rest of their margin, which every target must name; null texts have no tokens and are drawn;
    repeated and null ids are drawn together; texts of any length are counted whole; documents of one cell
    have equal probabilities; no documents: no rows.
    """
    return docs.filter(uniform(F.col("doc_id"), seed) < share(docs, targets))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability) of the documents that are drawn."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", "source", "lang", topic(text).alias("topic"), token_count(text).alias("n_tokens"),
        share(docs, targets).alias("probability")).filter(
        uniform(F.col("doc_id"), seed) < F.col("probability"))
