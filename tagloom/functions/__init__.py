"""Column expressions over alignment records; none of them needs Python on the executors."""
