"""python -m tessel ROOT COMMAND ...: collections from the command line. Results are JSON, one value a line.

    create NAME DIM [TYPE]          list                 get NAME ID            delete NAME ID
    insert NAME ID VECTOR [DOCUMENT [METADATA]]          search NAME VECTOR K [WHERE [WHERE_DOCUMENT]]
    tsne NAME [PERPLEXITY]          repl: reads commands from standard input

VECTOR is 0.1,0.2 or [0.1, 0.2]; DOCUMENT, METADATA, WHERE and WHERE_DOCUMENT are JSON (a DOCUMENT that isn't is a text).
"""

import json
import shlex
import sys

from pyspark.sql import SparkSession

from .errors import EngineError, InvalidRecord
from .schema import CollectionSchema, Record, SearchRequest
from .sources.codecs import to_dict
from .sources.collection import Store


def vector(text: str) -> list[float]:
    try:
        return [float(x) for x in text.strip().removeprefix("[").removesuffix("]").split(",")]
    except ValueError as e:
        raise InvalidRecord(f"not a vector: {text}") from e


def parsed(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def plain(record: Record) -> dict:
    return to_dict(record) | {"vector": None if record.vector is None else record.vector.tolist()}


def command(store: Store, words: list[str]) -> list:
    match words:
        case ["create", name, dim, *kind]:
            return [store.create_collection(CollectionSchema(name, int(dim), *kind)).schema.name]
        case ["list"]:
            return store.list_collections()
        case ["insert", name, key, v, *rest]:
            document, metadata = ([parsed(x) for x in rest] + [None, None])[:2]
            return [plain(r) for r in store.collection(name).insert([Record(key, vector(v), document, metadata)])]
        case ["get", name, key]:
            return [plain(store.collection(name).get(key))]
        case ["delete", name, key]:
            return [plain(r) for r in store.collection(name).delete([key])]
        case ["search", name, v, k, *rest]:
            where, where_document = ([json.loads(x) for x in rest] + [None, None])[:2]
            found = store.collection(name).search(SearchRequest(vector(v), int(k), where, where_document))
            return [{"record_id": r.record_id, "rank": r["rank"], "distance": r.distance, "document": r.document, "metadata": r.metadata and json.loads(r.metadata)} for r in found.collect()]
        case ["tsne", name, *perplexity]:
            return [r.asDict() for r in store.collection(name).tsne(None, *(float(p) for p in perplexity)).collect()]
    raise InvalidRecord(f"unknown command: {shlex.join(words)}")


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    store = Store(SparkSession.builder.getOrCreate(), args[0])
    lines = (shlex.split(line) for line in sys.stdin) if args[1:] == ["repl"] else [args[1:]]
    failed = 0
    for words in filter(None, lines):
        try:
            for value in command(store, words):
                print(json.dumps(value))
        except (EngineError, ValueError) as e:
            failed = 1
            print(json.dumps({"error": type(e).__name__, "message": str(e)}), file=sys.stderr)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
