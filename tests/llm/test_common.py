from accessgeo.llm.common import noted_paths, scratch


def test_blocks_of_noted_paths_end_by_themselves(spark):
    """An inner block that holds the same paths as the outer one ends alone: later paths go to the outer one only."""
    with noted_paths() as outer:
        with noted_paths() as inner:
            first = scratch(spark, "a")
        second = scratch(spark, "b")
    scratch(spark, "c")
    assert inner == [first]
    assert outer == [first, second]
