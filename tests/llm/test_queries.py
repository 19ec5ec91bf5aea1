from pulsegrid.llm.queries import QUERIES, SQL


def test_every_operator_is_registered_once():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(SQL) <= set(QUERIES) and all(isinstance(s, str) for s in SQL.values()) and all(callable(q) for q in QUERIES.values())
