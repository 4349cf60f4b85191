"""Compare queries with their oracles: `check.py [sf_dir] [name ...]`."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tests"))
from harness import compare, duck, local_session  # noqa: E402

args = sys.argv[1:]
sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
from opsdelta.plans import ORACLES, QUERIES  # noqa: E402

spark, con = local_session(), duck(sf)
skip = set(os.environ.get("SKIP", "").split())
names = [n for n in QUERIES if n not in skip and (not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args))]
bad = 0
for name in names:
    t = time.time()
    try:
        df = QUERIES[name](spark, sf)
        if name in ORACLES:
            problem = compare(df, con, ORACLES[name])
            word = "ok" if problem is None else "DIFF"
        else:
            problem, word = f"{df.count()} rows", "rows"
    except Exception as e:
        problem, word = str(e)[:1500], "ERROR"
        if os.environ.get("TRACE"):
            traceback.print_exc()
    bad += word in ("DIFF", "ERROR")
    print(f"{word:5} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
print("bad:", bad, "of", len(names))
