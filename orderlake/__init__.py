"""orderlake: order, delivery, sales and review marts as Spark DataFrame transforms."""
