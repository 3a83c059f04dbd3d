"""Reading tables and lifting them onto the tensor model; writing results."""
