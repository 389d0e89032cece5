"""Operators for large training-data pipelines. Nothing else in the package imports this one."""

import os

# One thread for numpy's linear algebra, in the driver and in the workers that it starts: a task has one core, and threads
# of a driver whose cores are busy wait for each other. Only has an effect where numpy has not been imported yet.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
