"""Plans: silver and gold transforms, and the jobs that read, run and write them."""
