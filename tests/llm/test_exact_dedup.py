import hashlib
import re
from collections import Counter

import pytest
from fixtures import ODD, odd_documents, plain

from polderlake.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        s = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups.setdefault(hashlib.sha256(s.encode()).hexdigest(), []).append(i)
    return groups


@pytest.mark.parametrize("blocks", [1, 1 << 20])
def test_groups_equal_brute_force(spark, blocks):
    rows = [(i, t) for i, t, _ in ODD if i is not None]
    rows += [(100 + i, f"text {i % 37}  of\tmany") for i in range(400)] + [(900 + i, "hot") for i in range(300)]
    got = exact_dedup.exact_groups(spark, plain(spark, rows), blocks).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        members = want[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(members), len(members))
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(want, 1))


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    got = exact_dedup.exact_groups(spark, docs).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got if r.doc_id == 7) == 1
    assert next(r.keep_id for r in got if r.doc_id == 4) == 3  # null and empty are one group
    assert next(r.kept for r in got if r.doc_id is None)
    assert exact_dedup.exact_groups(spark, docs.limit(0)).collect() == []


def test_plan_has_no_python_and_only_small_rows_move(spark):
    plan = exact_dedup.exact_groups(spark, odd_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
