import sys

from layerloom.cli import main

sys.exit(main())
