"""Inducing the rule list of ``quality`` by incremental reduced-error pruning.

``label`` names the kind of a text from its structure (line shapes, cells, alphabets, repetition) and
serves as the labeller of the training rows; it abstains (None) where it is not sure. The documents of
``quality_labels``, told by reading, have the kind that was read and check the learned rules. ``irep`` learns an
ordered rule list over the native statistics from a bounded sample of labelled rows
(``MAX_LABELLED``); ``python -m kgspark.llm.quality_fit FOLDER`` fits it on a folder's documents, prints
the agreement on a held-out third and writes ``quality_rules.py``.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

import numpy as np

from kgspark.llm.quality import COMMON, STATISTICS
from kgspark.llm.quality_labels import READ

#: Bound on labelled rows used for fitting.
MAX_LABELLED = 20_000
#: Runs of each kind with other grow/prune splits; the best on the fitting rows is kept.
RESTARTS = 32
KINDS = ("junk", "table", "list")
#: Directions a kind's rules may test a statistic in: they hold beyond the texts at hand. Sizes may be tested both ways.
_SIZES = [(s, op) for s in ("n_chars", "n_words", "n_lines") for op in ("<=", ">=")]
DIRECTIONS = {
    "junk": [("mean_word_len", ">="), ("symbol_ratio", ">="), ("digit_ratio", ">="), ("single_share", ">="), ("title_share", ">="), ("distinct_words", "<="), ("distinct_lines", "<="), ("common_share", "<="), ("item_chars", "<="), ("cell_share", "<="), *_SIZES],
    "table": [("cell_share", ">="), ("digit_ratio", ">="), ("symbol_ratio", ">="), ("common_share", "<="), ("end_punct_share", "<="), *_SIZES],
    "list": [("marker_share", ">="), ("short_open_share", ">="), ("open_chars", ">="), ("item_chars", ">="), ("end_punct_share", "<="), ("words_per_line", "<="), ("common_share", "<="), *_SIZES],
}

_MARK = re.compile(r"\s*(?:[-*•▪◦‣·→►>+✓✔☐☑☒–]+|\[[ xXхХ✓]?\]|\(?\d{1,3}[.)]|\(?[a-zа-я][.)])\s+\S", re.I)
_END = re.compile(r"[.!?…]['\"»”)\]]*\s*$")
_NEXT = re.compile(r"[а-яa-zäöüß]{2}['\"»”)]*[.!?…]\s+[А-ЯЁA-ZÄÖÜ]")
_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[а-яё][a-z]|[a-z][а-яё]", re.I)


def _cells(line: str) -> tuple[str, int] | None:
    for sep in ("|", "\t", ";", '","'):
        if line.count(sep) >= 1:
            return sep, line.count(sep)
    gaps = len(re.findall(r"\S {2,}(?=\S)", line))
    if gaps:
        return "  ", gaps
    packed = len(re.findall(r"\S,(?=\S)", line))
    return (",", packed) if packed >= 2 else None


def label(text: str | None) -> str | None:
    t = (text or "").replace("​", "").replace("﻿", "")
    words = [w.lower() for w in _WORD.findall(t)]
    solid = re.sub(r"\s", "", t)
    if not words:
        return "junk"
    lines = [x for x in re.split(r"[\r\n]+", t) if x.strip()]
    body = lines[1:] if len(lines) > 3 and re.search(r"[.!?…:]['\"»”)\]]*\s*$", lines[0]) and not _NEXT.search(lines[0]) else lines
    if len(body) >= 3:
        cells = [_cells(x) for x in body]
        seps = [c[0] for c in cells if c]
        if seps and max(seps.count(s) for s in set(seps)) >= 0.75 * len(body):
            return "table"
    if sum(c.isalnum() for c in solid) < 0.6 * len(solid):
        return "junk"
    if len(words) > 3 and sum(bool(_MIXED.search(w)) for w in words) > 0.3 * len(words):
        return "junk"
    if len(re.findall(r"[ÐÑ]", t)) > 0.1 * len(solid) or len(re.findall(r"[РС][^а-яёА-ЯЁ\s.,:;!?)-]", t)) > 0.1 * len(solid):
        return "junk"
    if sum(len(w) for w in words if len(w) > 25) > 0.5 * len(solid) or np.mean([len(w) for w in words]) > 16:
        return "junk"
    if re.search(r"[a-z][A-Z]", t) and len(re.findall(r"[a-z0-9][A-Z]", t)) > 0.08 * len(solid):
        return "junk"
    if len(words) > 20 and sum(len(w) <= 2 for w in words) > 0.6 * len(words):
        return "junk"
    if sum(bool(re.match(r"\s*\[?\d{4}-\d\d-\d\d[T ]", x)) for x in body) > 0.6 * len(body):
        return "junk"
    if len(words) >= 12 and len(set(words)) < 0.12 * min(len(words), 120):
        return "junk"
    if len(body) >= 4 and len(set(body)) < 0.5 * len(body):
        return "junk"
    common = sum(w in COMMON for w in words) / len(words)
    ends = sum(bool(_END.search(x)) for x in body) / len(body)
    if len(body) >= 3:
        items = [bool(_MARK.match(x) or len(_WORD.findall(x)) <= 8) and not _END.search(x) for x in body]
        marks = sum(bool(_MARK.match(x)) for x in body)
        wrapped = sum(45 <= len(x) <= 75 for x in body[:-1]) >= 0.7 * (len(body) - 1)
        share = sum(len(x) for x, i in zip(body, items, strict=True) if i) / sum(map(len, body))
        if sum(items) >= 3 and share > 0.4 and not (wrapped and marks < 0.5 * len(body)):
            return "list" if share >= 0.6 else None
    if len(words) >= 12 and len(set(words)) < 0.6 * len(words) and common < 0.1 and ends < 0.2 and len(words) < 200:
        return "junk"
    if len(words) >= 9 and len(set(words)) < 0.75 * len(words) and not re.search(r"[,;:?!]", t) and (ends < 0.2 or len(body) == 1):
        if sum(w[0].isupper() for w in _WORD.findall(t)) > 0.5 * len(words) and not t.isupper():
            return "junk"  # page furniture
    if len(words) >= 40 and common < 0.085:
        return "junk" if ends < 1 or len(lines) == 1 else None
    if len(words) >= 40 and common < 0.12:
        return None
    return "prose"


def _grow(x, y, names, allowed=None):
    """Conditions that cover rows of ``y`` only, by FOIL gain; ``allowed``: (statistic, comparison) pairs that may be tested."""
    conds, m = [], np.ones(len(y), bool)
    while (~y[m]).any() and len(conds) < 6:
        p0, n0 = y[m].sum(), (~y[m]).sum()
        base = np.log2(p0 / (p0 + n0))
        best = (1e-9, None, None)
        for j, name in enumerate(names):
            v = x[m, j]
            mine = v[y[m]]
            cuts = np.unique(np.concatenate([np.quantile(v, np.linspace(0.01, 0.99, 21)), np.quantile(mine, np.linspace(0, 1, 11))]))
            cuts = np.unique(np.concatenate([cuts, (cuts[1:] + cuts[:-1]) / 2]))
            for c in cuts:
                for op, k in (("<=", v <= c), (">=", v >= c)):
                    if allowed is not None and (name, op) not in allowed:
                        continue
                    p, n = (y[m] & k).sum(), (~y[m] & k).sum()
                    if p >= 5 and (gain := p * (np.log2(p / (p + n)) - base)) > best[0]:
                        best = (gain, (name, op, float(round(c, 6))), (j, op, float(round(c, 6))))
        if best[1] is None:
            break
        conds.append(best[1])
        j, op, c = best[2]
        m &= (x[:, j] <= c) if op == "<=" else (x[:, j] >= c)
    return conds


def covered(conds, x, names) -> np.ndarray:
    m = np.ones(len(x), bool)
    for name, op, c in conds:
        v = x[:, names.index(name)]
        m &= (v <= c) if op == "<=" else (v >= c)
    return m


def _prune(conds, x, y, names):
    def worth(c):
        m = covered(c, x, names)
        p, n = (y & m).sum(), (~y & m).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(conds) > 1:
        options = [[c for i, c in enumerate(conds) if i != k] for k in range(len(conds))]
        best = max(options, key=worth)
        if worth(best) < worth(conds):
            break
        conds = best
    return conds, worth(conds)


def irep(x: np.ndarray, kinds: np.ndarray, names: list[str], order=KINDS, seed: int = 7, most: int = 14, directions: dict | None = None) -> list:
    """Ordered rules for the kinds in ``order``; rows no rule covers get the default kind."""
    rng, rules = np.random.default_rng(seed), []
    for kind in order:
        misses = 0
        for _ in range(most):
            y = kinds == kind
            if y.sum() < 12:
                break
            take = rng.random(len(y)) < 2 / 3
            conds = _grow(x[take], y[take], names, directions.get(kind) if directions else None)
            if not conds:
                misses += 1
                if misses == 3:
                    break
                continue
            conds, good = _prune(conds, x[~take], y[~take], names)
            m = covered(conds, x, names)
            if good < 0.9 or not (y & m).any():
                misses += 1
                if misses == 3:
                    break
                continue
            rules.append((kind, conds))
            x, kinds = x[~m], kinds[~m]
    return rules


def apply_rules(rules, x, names, default="prose") -> np.ndarray:
    out = np.full(len(x), default, dtype=object)
    left = np.ones(len(x), bool)
    for kind, conds in rules:
        m = left & covered(conds, x, names)
        out[m] = kind
        left &= ~m
    return out


def write_rules(rules, path: Path) -> None:
    body = "".join(f"    ({k!r}, {c!r}),\n" for k, c in rules)
    path.write_text(f'"""Rules exported by ``quality_fit``: (kind, [(statistic, comparison, threshold), ...]) in order."""\n\nRULES: list = [\n{body}]\n')


def main(folder: str) -> None:
    from kgspark.llm.quality import with_statistics
    from kgspark.session import get_spark
    from kgspark.tables import table

    spark = get_spark("quality-fit", "local[8]")
    docs = table(spark, folder, "documents", "doc_id", "text").orderBy(_order()).limit(MAX_LABELLED)
    pdf = with_statistics(docs).select("doc_id", "text", "stats.*").toPandas()
    fit(pdf)


def _order():
    from pyspark.sql import functions as F

    return F.xxhash64("doc_id")


def fit(pdf) -> None:
    names = list(STATISTICS)
    pdf = pdf[~pdf.duplicated("text") | (pdf.n_words == 0)]  # blank texts weigh as often as they occur
    read = {i: kind for kind, ids in READ.items() for i in ids}
    kinds = np.array([read.get(i) or label(t) for i, t in zip(pdf.doc_id, pdf.text, strict=True)], dtype=object)
    known = np.array([k is not None for k in kinds])
    x, y = pdf[names].to_numpy(float)[known], kinds[known]
    test = np.random.default_rng(11).random(len(y)) < 1 / 3
    rules, left, left_y = [], x[~test], y[~test]
    for kind in KINDS:  # the best split for each kind, on the rows that no earlier rule covers
        tries = [irep(left, left_y, names, order=(kind,), seed=k, directions=DIRECTIONS) for k in range(RESTARTS)]
        best = max(tries, key=lambda r: ((apply_rules(r, left, names) == kind) == (left_y == kind)).mean())  # noqa: B023
        rest = apply_rules(best, left, names) != kind
        rules, left, left_y = rules + best, left[rest], left_y[rest]
    got = apply_rules(rules, x[test], names)
    print(f"{len(y)} labelled of {len(pdf)}; agreement on the held-out third: {(got == y[test]).mean():.4f}")
    for k in (*KINDS, "prose"):
        print(f"  {k}: precision {(y[test][got == k] == k).mean():.3f}, recall {(got[y[test] == k] == k).mean():.3f}, rows {(y[test] == k).sum()}")
    mine = pdf.doc_id.isin(read.keys()).to_numpy()
    told = np.array([read[i] for i in pdf.doc_id[mine]], dtype=object)
    print(f"  right on {(apply_rules(rules, pdf[names].to_numpy(float)[mine], names) == told).sum()} of {len(told)} read")
    for r in rules:
        print("  ", r)
    write_rules(rules, Path(__file__).with_name("quality_rules.py"))


if __name__ == "__main__":
    main(sys.argv[1])
