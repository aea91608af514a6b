"""The token store's manifest holds what its reader gives."""

import pytest

pytest.importorskip("cuewright.llm.queries")

from test_llm_operators import docs

from cuewright.llm import token_store


def test_lost_recipes_are_an_error(spark, tmp_path):
    path = f"{tmp_path}/store"
    token_store.write_store(docs(spark, [(i, f"text number {i}") for i in range(200)]), path)
    assert token_store.read_index(spark, path).count() == 200
    spark.read.parquet(f"{path}/recipes").where("doc_id <> 150").write.parquet(f"{tmp_path}/fewer")
    (tmp_path / "store" / "recipes").rename(tmp_path / "all")
    (tmp_path / "fewer").rename(tmp_path / "store" / "recipes")
    with pytest.raises(ValueError):
        token_store.read_index(spark, path)


def test_ties_of_ids_do_not_depend_on_the_partitioning(spark, tmp_path):
    rows = [(i % 3 if i % 4 else None, f"text number {i % 17} " * (1 + i % 5)) for i in range(80)]
    seen = []
    for parts in (1, 7):
        path = str(tmp_path / f"store{parts}")
        token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), path)
        seen.append(sorted(map(str, token_store.read_index(spark, path).collect())))
    assert seen[0] == seen[1]
