import sys

from voxelloom.plans.registry import main

sys.exit(main())
