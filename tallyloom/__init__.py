"""Sales and operations analytics as composable DataFrame programs."""

import os

# The driver's linear algebra is small; threads that began before the JVM was started may never answer.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
