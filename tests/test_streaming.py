"""State of the stream of documents: kept on disk, restarted from its checkpoint."""

import json

from tidemark.functions.text import match_key
from tidemark.streaming import background

SCHEMA = "doc_id string, text string"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"doc_id": i, "text": t}) + "\n" for i, t in rows))


def text(k):
    return " ".join(f"w{k}x{i}" for i in range(12))


def test_state_of_ten_batches_and_a_restart(spark, tmp_path):
    """Each batch has copies of the one before; a second query goes on where the first ended."""
    out, sizes = str(tmp_path / "out"), []
    for half in range(2):
        for b in range(5 * half, 5 * half + 5):
            put(tmp_path / "in", f"{b}.json", [(f"d{b}-{k}", text(k)) for k in range(10 * b - 5 if b else 0, 10 * b + 10)])
        docs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = background.collect_pools(docs, out, 10**9, 10**8, least_tokens=10)
        query.awaitTermination()
        sizes += background.state_sizes(query)
    keys = [s["keys"] for s in sizes if s["batch"] is not None]
    assert max(keys) == 100 and keys == sorted(keys) and len({s["batch"] for s in sizes}) >= 10 and all(s["bytes"] > 0 for s in sizes)
    pools = spark.read.parquet(f"{out}/pools")
    assert pools.count() == 100 == pools.select(match_key(pools.text)).distinct().count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != background.STATE["spark.sql.streaming.stateStore.providerClass"]
