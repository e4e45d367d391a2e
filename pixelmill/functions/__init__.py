"""Column functions: colour, transforms, coding laws."""
