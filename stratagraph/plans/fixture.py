"""A small repository written for the queries and tests: imports, an ambiguity, a cycle, inheritance, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "README.md": "Intro text that stands before any heading and is long enough.\n\n# Shop\n\nA shop that keeps orders in a store and sends notes.\n\n```\n# not a heading\n```\n\n## Use\n\nshort\n\n## Layout\n\nThe `shop/run.py` file starts everything; stores live in `shop/store`.\n",
    "requirements.txt": "flask==3.0\nsqlalchemy\n",
    "shop/run.py": '"""Start the shop."""\nfrom shop.store.memory import MemoryStore\nfrom shop import prices\nimport json\n\n\ndef main(argv: list) -> int:\n    """Run until done."""\n    store = MemoryStore()\n    store.put("a", prices.total([1]))\n    print(json.dumps(argv))\n    return helper()\n\n\ndef helper():\n    def inner():\n        return main([])\n    return inner()\n',
    "shop/prices.py": "RATE = 2\n\n\ndef total(items):\n    return sum(items) * rate()\n\n\ndef rate():\n    return RATE\n",
    "shop/store/base.py": 'from ..prices import total\n\n\nclass BaseStore:\n    """What every store can do."""\n\n    def put(self, key, value):\n        raise NotImplementedError\n\n    def sum_up(self):\n        return total([1, 2])\n',
    "shop/store/memory.py": "from .base import BaseStore\nimport shop.run\n\n\nclass MemoryStore(BaseStore):\n    def __init__(self):\n        self.rows = {}\n\n    def put(self, key, value):\n        self.rows[key] = value\n        self.notify(key)\n\n    def notify(self, key):\n        send(key)\n",
    "shop/notes.py": "def send(key):\n    return key\n",
    "lib/notes.py": "def send(key):\n    return None\n",
    "empty.py": "",
    "broken.py": "def (:\n",
    "web/base.ts": "/** A thing with a name. */\nexport class Base {\n  name(): string { return label(this); }\n}\nexport interface Named { name(): string }\n",
    "web/app.ts": "import { Base } from './base';\nimport fs from 'fs';\n\nexport class App extends Base implements Named {\n  private count = 0;\n  start(n: number): void {\n    this.name();\n    helper(n);\n  }\n}\n\n/** Adds one. */\nexport const helper = (n: number): number => {\n  return bump(n);\n};\n\nfunction bump(n: number) {\n  const inner = () => helper(n);\n  return n + 1;\n}\n",
    "web/main.js": "const app = require('./app');\nlet x = new App();\nfunction boot() { x.start(1); console.log(`a ${boot()}`); }\n",
}
QUESTIONS = [
    (1, "What calls `total`?"),
    (2, "Which classes inherit from BaseStore?"),
    (3, "Which files import shop/prices.py?"),
    (4, "What is the architecture of the shop?"),
    (5, "Explain how does MemoryStore.put() work"),
    (6, "what is in shop/prices.py"),
    (7, "What does `main` call?"),
    (8, "why are notes sent"),
]
REPOSITORY = "shop"


def files(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    from stratagraph.functions.paths import language

    rows = spark.createDataFrame([(REPOSITORY, p, len(t.encode()), t) for p, t in FILES.items()], "repository_id string, file_path string, length long, text string").coalesce(1)
    return rows.select("repository_id", "file_path", language(F.col("file_path")).alias("language"), "length", "text")
