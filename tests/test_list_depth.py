from threadloom.operators import layout


def test_list_deeper_than_eight(spark):
    """A chain of 12 items, one of them without content, keeps every item with content."""
    rows = [(1, k, k - 1 if k else None, k, "" if k == 5 else f"item {k}") for k in range(12)]
    items = spark.createDataFrame(rows, "list_id long, item_id long, parent_id long, ord int, content string")
    got = sorted((r.item_id, r.level, r.number) for r in layout.list_flatten(items).collect())
    assert got == [(k, k + 1 if k < 5 else k, 1) for k in range(12) if k != 5]
    assert layout.list_flatten(items.limit(0)).count() == 0
