"""What the findings of round 3 named in this folder's operators."""

import collections
import re

from phraseforge.llm import pii


def test_counts_are_of_base_spans(spark):
    """The CRF finds a phone that no pattern matches; the counts stay those of the patterns, as base_sha256 does."""
    said = [(1, "call +1 (017) 555-7713 190.137.2.9"), (2, "mail a.b@c.de or 10.0.0.25, 4539 1488 0343 6467"), (3, None), (4, "")]
    got = {r.doc_id: r for r in pii.find_personal(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    for d, t in said:
        base = collections.Counter(k for k, _, _ in pii.base_spans(t or ""))
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [base[k] for k in pii.KINDS]
        assert sum(base.values()) + got[d].n_added == len(re.findall("[a-z]+:", got[d].spans))
    assert got[1].n_added > 0 and got[1].n_phone == 0
