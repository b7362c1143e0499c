"""Pure ``Column -> Column`` functions; nothing in here touches a DataFrame or runs Python per row."""
