"""Search spaces, targets, statistics, lattice searches and results."""
