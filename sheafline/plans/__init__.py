"""Plans and configurations, resolved on the driver."""
