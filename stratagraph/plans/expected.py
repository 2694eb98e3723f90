"""What the parsers and the graph must give for the small repository of `fixture`, written down by hand-checking its files line by line."""

# (file, type, name, first line, last line, parent, signature, documentation, bases, calls)
PYTHON_ENTITIES = [
    ("empty.py", "module", "empty", 1, 1, None, None, None, "", ""),
    ("lib/notes.py", "function", "send", 1, 2, None, "def send(key)", None, "", ""),
    ("lib/notes.py", "module", "notes", 1, 2, None, None, None, "", ""),
    ("shop/notes.py", "function", "send", 1, 2, None, "def send(key)", None, "", ""),
    ("shop/notes.py", "module", "notes", 1, 2, None, None, None, "", ""),
    ("shop/prices.py", "module", "prices", 1, 9, None, None, None, "", ""),
    ("shop/prices.py", "function", "total", 4, 5, None, "def total(items)", None, "", "rate,sum"),
    ("shop/prices.py", "function", "rate", 8, 9, None, "def rate()", None, "", ""),
    ("shop/run.py", "module", "run", 1, 18, None, None, "Start the shop.", "", ""),
    ("shop/run.py", "function", "main", 7, 12, None, "def main(argv: list) -> int", "Run until done.", "", "MemoryStore,dumps,helper,print,put,total"),
    ("shop/run.py", "function", "helper", 15, 18, None, "def helper()", None, "", "inner"),
    ("shop/run.py", "function", "inner", 16, 17, "helper", "def inner()", None, "", "main"),
    ("shop/store/base.py", "module", "base", 1, 11, None, None, None, "", ""),
    ("shop/store/base.py", "class", "BaseStore", 4, 11, None, "class BaseStore", "What every store can do.", "", ""),
    ("shop/store/base.py", "method", "put", 7, 8, "BaseStore", "def put(self, key, value)", None, "", ""),
    ("shop/store/base.py", "method", "sum_up", 10, 11, "BaseStore", "def sum_up(self)", None, "", "total"),
    ("shop/store/memory.py", "module", "memory", 1, 14, None, None, None, "", ""),
    ("shop/store/memory.py", "class", "MemoryStore", 5, 14, None, "class MemoryStore(BaseStore)", None, "BaseStore", ""),
    ("shop/store/memory.py", "method", "__init__", 6, 7, "MemoryStore", "def __init__(self)", None, "", ""),
    ("shop/store/memory.py", "method", "put", 9, 11, "MemoryStore", "def put(self, key, value)", None, "", "notify"),
    ("shop/store/memory.py", "method", "notify", 13, 14, "MemoryStore", "def notify(self, key)", None, "", "send"),
]

JS_ENTITIES = [
    ("web/app.ts", "module", "app", 1, 21, None, None, None, "", ""),
    ("web/app.ts", "class", "App", 4, 10, None, "class App extends Base", None, "Base,Named", ""),
    ("web/app.ts", "method", "start", 6, 9, "App", "start(n: number): void", None, "", "helper,name"),
    ("web/app.ts", "function", "helper", 13, 15, None, "function helper(n: number)", "/** Adds one. */", "", "bump"),
    ("web/app.ts", "function", "bump", 17, 20, None, "function bump(n: number)", None, "", "helper"),
    ("web/app.ts", "function", "inner", 18, 18, "bump", "function inner()", None, "", "helper"),
    ("web/base.ts", "module", "base", 1, 6, None, None, None, "", ""),
    ("web/base.ts", "class", "Base", 2, 4, None, "class Base", "/** A thing with a name. */", "", ""),
    ("web/base.ts", "method", "name", 3, 3, "Base", "name(): string", None, "", "label"),
    ("web/base.ts", "class", "Named", 5, 5, None, "interface Named", None, "", ""),
    ("web/main.js", "module", "main", 1, 4, None, None, None, "", ""),
    ("web/main.js", "function", "boot", 3, 3, None, "function boot()", None, "", "start"),
]

# (relation, from, to, module, line) of calls, imports and inheritance
CODE_EDGES = [
    ("CLASS_INHERITS_CLASS", "Class:shop/store/memory.py:MemoryStore", "Class:shop/store/base.py:BaseStore", None, None),
    ("CLASS_INHERITS_CLASS", "Class:web/app.ts:App", "Class:web/base.ts:Base", None, None),
    ("CLASS_INHERITS_CLASS", "Class:web/app.ts:App", "Class:web/base.ts:Named", None, None),
    ("FILE_IMPORTS_FILE", "File:shop/run.py", "File:shop/prices.py", "shop", 3),
    ("FILE_IMPORTS_FILE", "File:shop/run.py", "File:shop/store/memory.py", "shop.store.memory", 2),
    ("FILE_IMPORTS_FILE", "File:shop/store/base.py", "File:shop/prices.py", "..prices", 1),
    ("FILE_IMPORTS_FILE", "File:shop/store/memory.py", "File:shop/run.py", "shop.run", 2),
    ("FILE_IMPORTS_FILE", "File:shop/store/memory.py", "File:shop/store/base.py", ".base", 1),
    ("FILE_IMPORTS_FILE", "File:web/app.ts", "File:web/base.ts", "./base", 1),
    ("FILE_IMPORTS_FILE", "File:web/main.js", "File:web/app.ts", "./app", 1),
    ("FUNCTION_CALLS_FUNCTION", "Function:shop/prices.py:total", "Function:shop/prices.py:rate", None, 5),
    ("FUNCTION_CALLS_FUNCTION", "Function:shop/run.py:helper", "Function:shop/run.py:inner", None, 18),
    ("FUNCTION_CALLS_FUNCTION", "Function:shop/run.py:inner", "Function:shop/run.py:main", None, 17),
    ("FUNCTION_CALLS_FUNCTION", "Function:shop/run.py:main", "Function:shop/prices.py:total", None, 10),
    ("FUNCTION_CALLS_FUNCTION", "Function:shop/run.py:main", "Function:shop/run.py:helper", None, 12),
    ("FUNCTION_CALLS_FUNCTION", "Function:shop/run.py:main", "Method:shop/store/memory.py:MemoryStore:put", None, 10),
    ("FUNCTION_CALLS_FUNCTION", "Function:web/app.ts:bump", "Function:web/app.ts:helper", None, 18),
    ("FUNCTION_CALLS_FUNCTION", "Function:web/app.ts:helper", "Function:web/app.ts:bump", None, 14),
    ("FUNCTION_CALLS_FUNCTION", "Function:web/app.ts:inner", "Function:web/app.ts:helper", None, 18),
    ("FUNCTION_CALLS_FUNCTION", "Function:web/main.js:boot", "Method:web/app.ts:App:start", None, 3),
    ("FUNCTION_CALLS_FUNCTION", "Method:shop/store/base.py:BaseStore:sum_up", "Function:shop/prices.py:total", None, 11),
    ("FUNCTION_CALLS_FUNCTION", "Method:web/app.ts:App:start", "Function:web/app.ts:helper", None, 8),
    ("METHOD_CALLS_METHOD", "Method:shop/store/memory.py:MemoryStore:put", "Method:shop/store/memory.py:MemoryStore:notify", None, 11),
    ("METHOD_CALLS_METHOD", "Method:web/app.ts:App:start", "Method:web/base.ts:Base:name", None, 7),
]

# (question, step, place of the name, place of the row, fact, file, type, name, first line, last line, tier, relationship)
FACTS = [
    (1, 1, 0, 1, "function total is defined at shop/prices.py:4-5", "shop/prices.py", "function", "total", 4, 5, 0, "definition"),
    (1, 3, 0, 1, "function main (shop/run.py:7-12) calls total", "shop/run.py", "function", "main", 7, 12, 1, "calls total"),
    (1, 3, 0, 2, "method sum_up (shop/store/base.py:10-11) calls total", "shop/store/base.py", "method", "sum_up", 10, 11, 1, "calls total"),
    (2, 1, 0, 1, "class BaseStore is defined at shop/store/base.py:4-11", "shop/store/base.py", "class", "BaseStore", 4, 11, 0, "definition"),
    (2, 2, 0, 1, "class BaseStore (shop/store/base.py:4-11) defines: put, sum_up", "shop/store/base.py", "method", "put", 7, 8, 3, "method of BaseStore"),
    (2, 2, 0, 2, None, "shop/store/base.py", "method", "sum_up", 10, 11, 3, "method of BaseStore"),
    (2, 5, 0, 1001, "classes inheriting from BaseStore: MemoryStore (shop/store/memory.py)", "shop/store/memory.py", "class", "MemoryStore", 5, 14, 1, "subclass of BaseStore"),
    (3, 6, 0, 1, "shop/prices.py is imported by: shop/run.py, shop/store/base.py", "shop/run.py", "file", "shop/run.py", 0, 0, 2, "imports shop/prices.py"),
    (3, 6, 0, 2, None, "shop/store/base.py", "file", "shop/store/base.py", 0, 0, 2, "imports shop/prices.py"),
    (4, 8, 0, 1, "Files imported most: shop/prices.py (2 importers), shop/run.py (1 importers), shop/store/base.py (1 importers), shop/store/memory.py (1 importers), web/app.ts (1 importers), web/base.ts (1 importers)", "shop/prices.py", "file", "shop/prices.py", 0, 0, 2, "imported by 2 files"),
    (4, 8, 0, 2, None, "shop/run.py", "file", "shop/run.py", 0, 0, 2, "imported by 1 files"),
    (4, 8, 0, 3, None, "shop/store/base.py", "file", "shop/store/base.py", 0, 0, 2, "imported by 1 files"),
    (4, 8, 0, 4, None, "shop/store/memory.py", "file", "shop/store/memory.py", 0, 0, 2, "imported by 1 files"),
    (4, 8, 0, 5, None, "web/app.ts", "file", "web/app.ts", 0, 0, 2, "imported by 1 files"),
    (5, 1, 0, 1, "method BaseStore.put is defined at shop/store/base.py:7-8", "shop/store/base.py", "method", "put", 7, 8, 0, "definition"),
    (5, 1, 0, 2, "method MemoryStore.put is defined at shop/store/memory.py:9-11", "shop/store/memory.py", "method", "put", 9, 11, 0, "definition"),
    (5, 1, 1, 1, "class MemoryStore is defined at shop/store/memory.py:5-14", "shop/store/memory.py", "class", "MemoryStore", 5, 14, 0, "definition"),
    (5, 2, 1, 1, "class MemoryStore (shop/store/memory.py:5-14) defines: __init__, notify, put", "shop/store/memory.py", "method", "__init__", 6, 7, 3, "method of MemoryStore"),
    (5, 2, 1, 2, None, "shop/store/memory.py", "method", "put", 9, 11, 3, "method of MemoryStore"),
    (5, 2, 1, 3, None, "shop/store/memory.py", "method", "notify", 13, 14, 3, "method of MemoryStore"),
    (6, 7, 0, 1, "shop/prices.py defines functions rate, total", "shop/prices.py", "function", "total", 4, 5, 3, "defined in shop/prices.py"),
    (6, 7, 0, 2, None, "shop/prices.py", "function", "rate", 8, 9, 3, "defined in shop/prices.py"),
    (7, 1, 0, 1, "function main is defined at shop/run.py:7-12", "shop/run.py", "function", "main", 7, 12, 0, "definition"),
    (7, 3, 0, 1, "function inner (shop/run.py:16-17) calls main", "shop/run.py", "function", "inner", 16, 17, 1, "calls main"),
    (7, 4, 0, 1, "main calls total (shop/prices.py:4-5)", "shop/prices.py", "function", "total", 4, 5, 1, "called by main"),
    (7, 4, 0, 2, "main calls helper (shop/run.py:15-18)", "shop/run.py", "function", "helper", 15, 18, 1, "called by main"),
    (7, 4, 0, 3, "main calls put (shop/store/memory.py:9-11)", "shop/store/memory.py", "method", "put", 9, 11, 1, "called by main"),
]

# (question, answer, verified, unverified, grounded, abstained)
ANSWERS = [
    (1, "Loaded in `app/core/session{n}.py:10-20` and app/main{n}.py (lines not confirmed), see app/main{n}.py (lines not confirmed) again.", 1, 1, 0, 0),
    (2, "No citation at all.\n\nEvidence found for this question:\n- a/b{n}.py:1-9\n- a/d{n}.py:5-6", 0, 0, 1, 0),
    (3, "Wrong: lib/base{n}.ts (lines not confirmed) and lib/none{n}.ts (lines not confirmed), right: lib/base{n}.ts:3 - 4.", 1, 2, 0, 0),
    (4, "", 0, 0, 1, 1),
    (5, "See a{n}.py:10-20 and a{n}.py (lines not confirmed). Also `xa{n}.py:1-3` and a{n}.py (lines not confirmed), not a{n}.py (lines not confirmed).", 2, 3, 0, 0),
]
