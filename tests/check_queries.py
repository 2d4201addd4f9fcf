"""Compare all or the named queries with their SQL: python tests/check_queries.py DIR [name...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from compare import connect, differences  # noqa: E402

from veilframe.catalog import REGISTRY  # noqa: E402
from veilframe.session import build_session  # noqa: E402


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in names:
        item = REGISTRY[name]
        started = time.time()
        try:
            problems = differences(item.run(spark, sf_dir), con, item.sql) if item.sql else []
        except Exception as error:  # noqa: BLE001 - report and go on
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        print(f"{'ok ' if not problems else 'BAD'} {time.time() - started:6.2f}s {name}", flush=True)
        if problems:
            bad.append(name)
            for p in problems:
                print("    " + p[:2000], flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} equal; bad: {bad}")


if __name__ == "__main__":
    main()
