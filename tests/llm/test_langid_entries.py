"""Language identification where one language has most of the words."""

import random
from collections import Counter

from graphloom.llm import langid


def made(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=9)) for _ in range(n))


def test_all_entries_of_the_sample_are_kept(spark):
    rng = random.Random(6)
    shared = "abcdefghijkl"
    rows = [(i, made(rng, shared, 400), "big") for i in range(900)] + [(900 + i, made(rng, "zyxw" + shared, 30), "rare") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    model = langid.train(docs)
    want, seen = {k: set() for k in (0, *langid.ORDERS)}, Counter()
    for r in docs.where(~langid.held_out("doc_id")).collect():
        for w in langid.words_of(r.text):
            want[0].add(w)
            seen[r.lang] += 1
            for order in langid.ORDERS:
                marked = f"^{w}$" if order > 1 else w
                want[order] |= {marked[i : i + order] for i in range(len(marked) - order + 1)}
    assert min(seen.values()) > 0 and {k: set(v) for k, v in model.known.items()} == want
    found = langid.predict(docs.where(langid.held_out("doc_id")), model).select("lang", "predicted.lang_pred").collect()
    right, of = Counter(r.lang for r in found if r.lang == r.lang_pred), Counter(r.lang for r in found)
    print("accuracy by language", {k: f"{right[k]} of {n}" for k, n in of.items()})
    assert all(right[k] >= 0.95 * n for k, n in of.items())
