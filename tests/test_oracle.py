"""Every registered query against its DuckDB SQL on the smallest test tables."""

import pytest
from check_oracle import compare, duck
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql
from fundspark.registered.base import QUERIES

ORACLE = {name: sql for name, sql in oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    problem = compare(spark, con, QUERIES[name], ORACLE[name], SMALL)
    # Some filters select nothing from the smallest tables.
    assert problem in ("", "no rows"), problem


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    result = entry(spark)
    assert result.columns == [
        "ranking", "cpf_cnpj_gestor", "gestor", "numero_veiculos", "patrimonio_total_sob_gestao",
    ]
    assert [r.ranking for r in result.collect()] == list(range(1, result.count() + 1))
