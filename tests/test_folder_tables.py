"""Queries over tables that are folders of part files, as Spark writes them."""

import pytest

from chapterflow.plans.queries import QUERIES

DOCS = [(k, " ".join(f"palabra{j % 7}" for j in range(20 * k + 1)) if k % 4 else None, "es", "web", 10) for k in range(12)]
EVENTS = [(k, f"2024-01-01 00:00:{k:02d}", k % 3, ["signup", "view", "click", "purchase", "error"][k % 5], float(k), f'{{"k": {k}}}') for k in range(40)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same tables in many files and in one."""
    out = []
    for parts in (20, 1):
        root = str(tmp_path_factory.mktemp(f"parts{parts}"))
        spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(parts).write.parquet(f"{root}/documents.parquet")
        spark.createDataFrame(EVENTS, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").repartition(parts).write.parquet(f"{root}/events.parquet")
        out.append(root)
    return out


@pytest.mark.parametrize("name", ["confidence_windows_stream", "distinct_words_stream", "process_stage_stream", "run_state_stream", "spend_alerts_stream"])
def test_streams_read_folder_tables(spark, folders, name):
    many, one = (sorted(map(str, QUERIES[name](spark, root).collect())) for root in folders)
    assert many and many == one
