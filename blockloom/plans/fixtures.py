"""Small pairs of source texts in every language, for queries and tests that need code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = {
    "ts": (
        "gauge.ts",
        "import { A, b as c } from './a';\nexport const LIMIT = 10;\n\n// Reads a gauge.\nexport class Gauge {\n  private value = 0;\n  read() {\n    return this.value;\n  }\n  updated() {\n    this.read();\n  }\n}\nexport { Gauge as G };\n",
        "import { A, b as c } from './a';\nexport const LIMIT = 12;\n\n// Reads a gauge.\nexport class Gauge {\n  private value = 1;\n  fetchValue() {\n    return this.value;\n  }\n  updated() {\n    this.fetchValue();\n  }\n}\nexport { Gauge as G };\n",
    ),
    "tsx": (
        "panel.tsx",
        "const Panel = (props) => {\n  return (\n    <div class=\"p\">\n      <span>{props.a}</span>\n    </div>\n  );\n};\n",
        "const Panel2 = (props) => {\n  return (\n    <div class=\"p\">\n      <span>{props.a}</span>\n      <br/>\n    </div>\n  );\n};\n",
    ),
    "go": (
        "store.go",
        "package store\n\nimport \"fmt\"\n\n// Store keeps items.\ntype Store struct {\n\titems []string\n}\n\nfunc (s *Store) Add(x string) {\n\ts.items = append(s.items, x)\n}\n\nvar limit = 3\n",
        "package store\n\nimport \"fmt\"\n\n// Store keeps items.\ntype Store struct {\n\titems []string\n\tn int\n}\n\nfunc (s *Store) Append(x string) {\n\ts.items = append(s.items, x)\n}\n\nvar limit = 3\n",
    ),
    "bash": ("run.sh", "#!/bin/bash\nNAME=old\ngreet() {\n  echo \"hi $NAME\"\n}\ngreet\n", "#!/bin/bash\nNAME=new\ngreet() {\n  echo \"hello $NAME\"\n}\nbye() { echo bye; }\ngreet\n"),
    "c": (
        "count.c",
        "#include <stdio.h>\n#define MAX 3\nstatic int total = 0;\n\nint count(int x) {\n  return x + MAX;\n}\n",
        "#include <stdio.h>\n#define MAX 4\nstatic int total = 0;\n\nint count_all(int x) {\n  return x + MAX;\n}\n",
    ),
    "cpp": (
        "shape.cpp",
        "namespace geo {\nclass Shape {\n public:\n  int area() const { return w * h; }\n private:\n  int w, h;\n};\n}\nint geo_main() { return 0; }\n",
        "namespace geo {\nclass Shape {\n public:\n  int area() const { return w * h + 1; }\n  void reset() { w = h = 0; }\n private:\n  int w, h;\n};\n}\nint geo_main() { return 0; }\n",
    ),
    "quux": ("notes.quux", "one\ntwo\nthree\n", "one\n2\nthree\n"),
}
_names = list(SOURCES)


def code_pairs(spark: SparkSession) -> DataFrame:
    """Every fixture as old and new version, and each language turned into the next one."""
    rows = [(f"{k}", n, a, n, b) for k, (n, a, b) in SOURCES.items()]
    for k, other in zip(_names, _names[1:] + _names[:1]):
        rows.append((f"{k}-{other}", SOURCES[k][0], SOURCES[k][1], SOURCES[other][0], SOURCES[other][2]))
    return spark.createDataFrame(rows, "pair_id string, old_name string, old_src string, new_name string, new_src string")
