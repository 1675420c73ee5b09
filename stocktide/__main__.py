"""Command line:

python -m stocktide gold SF_DIR FOLDER [TABLE...]      gold tables, a run log and a summary
python -m stocktide silver RAW_DIR SILVER_DIR [STATE...]  raw wide files to the silver table, the states that it lacks
python -m stocktide manifest RAW_DIR PATH              shapes and checksums of raw files, to be kept
python -m stocktide verify RAW_DIR PATH                what differs from them; an error if anything does
python -m stocktide replay SF_DIR FOLDER [WEEKS [MODELS]]  the planning cycle of the last weeks; with a folder for models, of the learned model too
python -m stocktide extract GOLD_DIR FOLDER            what dashboards read
python -m stocktide web GOLD_DIR FOLDER                JSON files
"""

from __future__ import annotations

import json
import sys

from stocktide.plans import gold, web
from stocktide.session import session
from stocktide.sources import content, m5, store


def main(args: list[str]) -> None:
    command, rest = (args[0], args[1:]) if args else ("", [])
    if command == "gold" and len(rest) >= 2:
        done = gold.build(session(), rest[0], rest[1], rest[2:] or None)
    elif command == "silver" and len(rest) >= 2:
        spark = session()
        done = m5.build_if_missing(spark, rest[0], rest[1], rest[2:] or m5.states(spark, rest[0]))
    elif command == "replay" and len(rest) >= 2:
        from stocktide.plans.q_forecast import replay

        weeks = int(rest[2]) if len(rest) > 2 else 5
        store.write_gold({"planning_cycle": replay(session(), rest[0], weeks)}, rest[1])
        if len(rest) > 3:
            from stocktide.plans.q_models import learned_replay

            store.write_gold({"planning_cycle_learned": learned_replay(session(), rest[0], weeks, rest[3])}, rest[1])
        done = rest[1]
    elif command == "manifest" and len(rest) == 2:
        content.raw_manifest(session(), rest[0]).coalesce(1).write.parquet(rest[1])
        done = rest[1]
    elif command == "verify" and len(rest) == 2:
        done = content.verify(session(), *rest)
        if done:
            sys.exit("\n".join(done))
    elif command == "extract" and len(rest) == 2:
        done = web.extract(session(), *rest)
    elif command == "web" and len(rest) == 2:
        done = web.build(session(), *rest)
    else:
        sys.exit(__doc__)
    print(json.dumps(done))


if __name__ == "__main__":
    main(sys.argv[1:])
