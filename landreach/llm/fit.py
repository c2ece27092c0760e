"""Fits the rule list of ``quality`` and writes it to ``fitted.py``: python -m landreach.llm.fit

Prints how well it does on labelled lines it hasn't seen, on forms that were
left out of the fit, and what statistics of whole documents do without any kind
of line.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from landreach.llm import labelled, lines, rules

#: Labelled documents that rules are fitted on, and the most a line weighs: bounds, whatever the corpus.
DOCUMENTS, HEAVIEST = 3_000, 400
ORDER = ["junk", "table", "list"]
#: Statistics of a whole document that the comparison without line kinds may test.
WHOLE = ["word_count", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "mean_line_length", "repeat_share"]


def data(n: int, seed: int, common: frozenset[bytes], forms: frozenset[str] = frozenset()) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Features, kinds and sizes of labelled lines, and all that was counted."""
    made = labelled.lines(n, seed, forms)
    got = lines.of_texts([m[0] for m in made], common)
    full = got["size"] > 0
    return {f: got[f][full] for f in lines.FEATURES}, np.array([k for m in made for k in m[1]], dtype=object), got["size"][full], {k: v[full] for k, v in got.items()}


def fit(common: frozenset[bytes], without: frozenset[str] = frozenset(), n: int = DOCUMENTS) -> list[rules.Rule]:
    x, y, w, _ = data(n, 7, common, without)
    return rules.induce(x, y, ORDER, np.minimum(w, HEAVIEST))


def judged(found: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, tuple[float, float]]:
    """Recall and precision by kind, in characters."""
    return {k: (float((w * ((found == k) & (y == k))).sum() / max(1, (w * (y == k)).sum())), float((w * ((found == k) & (y == k))).sum() / max(1, (w * (found == k)).sum()))) for k in ORDER}


def whole(n: int, seed: int, common: frozenset[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """WHOLE and the kind of each labelled document."""
    _, y, w, c = data(n, seed, common)
    doc, docs = c["doc"], int(c["doc"].max()) + 1
    total = lambda v: np.bincount(doc, v, docs)
    s = {k: total(c[k]) for k in lines.COUNTS}
    words, solid, count = np.maximum(s["words"], 1), np.maximum(s["solid"], 1), np.maximum(total(np.ones(len(doc))), 1)
    x = dict(zip(WHOLE, [s["words"], s["solid"] / words, s["symbols"] / solid, s["digits"] / solid, s["stops"] / count, s["known"] / words, s["size"] / count, s["again"] / np.maximum(s["size"], 1)]))
    kind = np.full(docs, "none", dtype=object)
    for k in ORDER:
        kind[2 * total(w * (y == k)) > s["size"]] = k
    return x, kind


def main() -> None:
    from landreach.llm.words import COMMON

    common = frozenset(w.encode() for w in COMMON)
    found = fit(common)
    x, y, w, _ = data(1_000, 99, common)
    print("unseen lines (recall, precision):", judged(rules.decide(found, x), y, w))
    for form in random.Random(0).sample(sorted(labelled.FORMS), len(labelled.FORMS)):
        x, y, w, _ = data(400, 5, common, frozenset(labelled.FORMS) - {form})
        kind = labelled.FORMS[form]
        print(f"{kind} as {form}, left out of the fit: recall", round(judged(rules.decide(fit(common, frozenset({form}), 1_000), x), y, w)[kind][0], 3))
    xs, ys = whole(DOCUMENTS, 7, common)
    xt, yt = whole(1_000, 99, common)
    only = rules.decide(rules.induce(xs, ys, ORDER), xt, "none")
    print("documents by their own statistics only (recall, precision):", judged(only, yt, np.ones(len(yt))))
    text = rules.to_sql(found).replace(" WHEN ", "\nWHEN ").replace(" ELSE ", "\nELSE ")
    Path(__file__).with_name("fitted.py").write_text(f'"""Written by fit.py; see there."""\n\nRULES = """\n{text}\n"""\n')


if __name__ == "__main__":
    main()
