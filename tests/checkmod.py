"""python tests/checkmod.py SF module-suffix ..."""
import sys
sys.path.insert(0, "/root/repo/tests"); sys.path.insert(0, "/root/repo")
import check
from tallygrid.plans import catalog as R
check.main(sys.argv[1], [n for n, f in R.QUERIES.items() if any(f.__module__.endswith(m) for m in sys.argv[2:])])
