"""Statistics, selectivities, costs and the choice of views and join orders."""
