"""Run the SQL checks with tiny limits, so every split and sketch path is taken."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factorloom.session import local_session  # noqa: E402
from tests.check_oracle import main  # noqa: E402

if __name__ == "__main__":
    spark = local_session(8)
    spark.conf.set("spark.factorloom.blockRows", "100")
    spark.conf.set("spark.factorloom.exactRows", "0")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    sys.exit(bool(main(folder, sys.argv[2:])))
