import sys

from eigenflux.cli import main

sys.exit(main())
