"""``python -m siltwork``."""

import sys

from siltwork.cli import main

sys.exit(main(sys.argv[1:]))
