"""Benchmark items in unspaced scripts and of few words."""

import pytest

pytest.importorskip("cuewright.llm.queries")

from test_llm_operators import docs

from cuewright.llm import decontamination


def test_unspaced_scripts_and_short_items(spark):
    item = "机器学习模型需要大量数据。训练之前必须先清理文本内容。"
    items = [(1, item), (2, "too short"), (3, "ภาษาไทยไม่มีช่องว่าง"), (4, None), (5, "。！")]
    rows = [
        (1, "前文在此，" + item + "后文在此。"),
        (2, "前文" + item.replace("模型", "方法").replace("。", "，") + "后文"),
        (3, "it is Too—short, really"), (4, "too very short"), (5, "นี่คือภาษาไทยไม่มีช่องว่างครับ"), (6, "机器在别处，数据也在别处。"), (7, "plain words"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(1, 1, 0), (2, 1, 2), (3, 2, 0), (5, 3, 0)}
    assert sorted(r.doc_id for r in decontamination.clean(docs(spark, rows), bench).collect()) == [4, 6, 7]
