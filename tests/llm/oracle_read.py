"""Tables read without Spark, for brute force."""

import pyarrow.dataset as ds

SF_SMALL = "/root/testdata/sf0.001"


def documents(folder: str) -> list[tuple]:
    table = ds.dataset(f"{folder}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    return list(zip(table["doc_id"], table["text"]))
