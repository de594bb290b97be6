"""python -m sheafline list | query NAME FOLDER [ROWS]"""

import sys

from pyspark.sql import SparkSession

from . import catalog
from .sources.stores import markdown


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print(*sorted(catalog.QUERIES), sep="\n")
        return 0
    if args[:1] == ["query"] and len(args) in (3, 4) and args[1] in catalog.QUERIES:
        spark = SparkSession.builder.appName("sheafline").getOrCreate()
        print(markdown(catalog.QUERIES[args[1]](spark, args[2]), int(args[3]) if len(args) == 4 else 20))
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
