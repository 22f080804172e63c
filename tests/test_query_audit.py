"""SQL rules on texts with comments, literals, names and subqueries."""

import pytest

from cleansheet.operators.query_audit import audit_rules

CASES = {
    "/* x */ delete from t": {"delete_without_where"},
    "delete from t -- where a = 1": {"delete_without_where"},
    "delete from t where a = 1": set(),
    "DELETE FROM t WHERE a IN (select b from u where c = 1)": set(),
    "select a from t where x = 1 -- drop; delete": set(),
    "select a from t where x = 1 --": {"injection_pattern"},
    "select a from t where x = 1; drop table t": {"injection_pattern", "drop"},
    "select a from t where x = 'a; drop table t' or y = 'it''s -- 1' limit 1;": set(),
    "with c as (select a from t where x = 1) select a from c": {"select_without_where"},
    "with c as (select * from t) select a from c where a = 1": {"select_star", "select_without_where"},
    "with c as (select a from t where x = 1), d (e) as (select a from c where a > 2) delete from u": {"delete_without_where"},
    "with x as (delete from t returning a) select a from x where a = 1": {"delete_without_where"},
    "select a from t where x in (select y from u where y = null)": {"eq_null"},
    "update t set a = null where b = 1": set(), "update t set a = 1": {"update_without_where"},
    "update t set a = (select max(b) from u where c = 1)": {"update_without_where"},
    "update t set a = 1 where b != NULL": {"eq_null"},
    "select rank() over (partition by a order by b) from t where c = 1": set(),
    "select a from t where b = 1 order by a": {"order_without_limit"},
    "select a from (select a from t where b = 1 order by a limit 3) q where a > 0": set(),
    "select a from t, u where t.i = u.i": {"cartesian_join"},
    "select f(a, b), c from t where d in (1, 2, 3)": set(),
    "select a from t natural join u where a = 1": set(),
    "select a from t join u using (i) join v on v.i = u.i where a = 1": set(),
    "select a from t join u where a = 1": {"cartesian_join"},
    "select a from t where year(d) = 2024": {"function_on_column"},
    "select a from t where b = 1 and (c) = 2": set(), "select a from t where d = date_trunc('day', now())": set(),
    "select a from t where b in (select c from u where lower(name) = 'x')": {"function_on_column"},
    "select a from t where b like '%x'": {"leading_wildcard_like"}, "select a from t where b like 'x%'": set(),
    "select a from t where \"like '%x\" = 1": set(), 'select a from "select * from (" where b = 1': set(),
    "select `a from` from t where b = 1": set(),
    "select (a from t where b = 1": {"unbalanced_parens"}, "select a) from t where b = (1": {"unbalanced_parens"},
    "select ')' from t where b = '((' /* ( */ -- (": set(),
    "select a from t where b = 1 union all select a from u": {"select_without_where"},
    "select 1": {"select_without_from", "select_without_where"},
    "select a, count(*) from t where b = 1 having count(*) > 1": {"having_without_group"},
    "select a, count(*) from t where b = 1 group by a having count(*) > 1": set(),
    "select distinct a from t where b = 1": {"distinct_used"}, "select count(distinct a) from t where b = 1": set(),
    "insert into t select * from u": {"select_star", "select_without_where"}, "insert into t values (1, 'select *')": set(),
    "truncate table t": {"truncate"}, "/* a */ -- b\n drop table t": {"drop"}, "grant select on t to u": set(),
    "select a from t where b = 1 or 1=1": {"injection_pattern"}, "select a from t where note = 'or 1=1'": set(),
    "": set(), "   ": set(), "-- nothing": set(), "'never closed": set(), "/* never closed": set(), "((((": {"unbalanced_parens"},
}


def test_cases(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(CASES)] + [(-1, None)], "id long, input_text string")
    got = {}
    for r in audit_rules(df).collect():
        got.setdefault(r["id"], set()).add(r["rule"])
    for i, (query, expected) in enumerate(CASES.items()):
        assert got.get(i, set()) == expected, query


@pytest.mark.parametrize("n", [50, 3000])
def test_long_and_deep_texts(spark, n):
    texts = [
        (1, "select a from t where b = " + "(" * n + "1" + ")" * n), (2, "select a from t where b = '" + "x''" * n * 20 + "'"),
        (3, "select a from t where " + " or ".join(f"(b = {i})" for i in range(n))), (4, "/*" + "(" * n * 20 + "*/ delete from t"),
    ]
    got = {(r["id"], r["rule"]) for r in audit_rules(spark.createDataFrame(texts, "id long, input_text string")).collect()}
    assert got == {(4, "delete_without_where")}
