"""Column expressions and numpy kernels; the kernels import no Spark."""
