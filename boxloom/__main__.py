import sys

from boxloom.cli import main

sys.exit(main())
